"""codeloom: a DataFrame-native engine for analysing and retrieving code and text."""
