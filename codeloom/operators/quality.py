"""Style rules by line, code measures, side-by-side differences, outlines and documentation."""

from __future__ import annotations

import ast
import difflib
import re
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.operators.parsing import _per_file, braces_balanced
from codeloom.operators.rounds import spread

MAX_LINE = 100
SHOWN = 50


#: What ends a line, and what counts as blank: in ASCII, and all white space of Unicode.
LINE_END = "\r\n|[\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
ASCII_BLANK = r"[\t\n\x0b\f\r\x1c\x1d\x1e\x1f ]"
WIDE_BLANK = r"[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
BLANK = ASCII_BLANK[:-1] + WIDE_BLANK[1:]
WORD = r"\p{L}\p{N}_"


def numbered_lines(files: DataFrame, key: str, text: str) -> DataFrame:
    """key, line number, line, whether it is blank, whether the two before it are blank too, whether it is the last and the text doesn't end with a line break, and whether the text has blanks beyond ASCII; a line break at the end starts no line."""
    body = F.regexp_replace(F.col(text), LINE_END, "\n")
    some = spread(files.select(key, text)).filter(F.coalesce(F.col(text), F.lit("")) != "")
    cut = some.select(key, F.split(F.regexp_replace(body, r"\n\z", ""), "\n", -1).alias("_lines"), (~F.endswith(F.col(text), F.lit("\n"))).alias("_open"), F.rlike(F.col(text), F.lit(WIDE_BLANK)).alias("wide"))
    blank = cut.withColumn("_blank", F.transform("_lines", lambda x: F.rlike(x, F.lit(f"^{BLANK}*$"))))
    # the two lines before each: the same flags, shifted
    before = lambda n: F.concat(F.array(*[F.lit(False)] * n), F.col("_blank")).alias(f"_before{n}")
    shifted = blank.select(key, "wide", "_open", "_lines", "_blank", before(1), before(2), F.size("_lines").alias("_size"))
    # explode alone would have its array made once more, by a filter on its size
    each = shifted.select(key, "wide", "_open", "_size", F.posexplode_outer(F.slice(F.arrays_zip("_lines", "_blank", "_before1", "_before2"), F.lit(1), F.col("_size"))).alias("n", "x"))
    third = F.col("x._blank") & F.col("x._before1") & F.col("x._before2")
    return each.select(key, (F.col("n") + 1).alias("line_no"), F.col("x._lines").alias("line"), F.col("x._blank").alias("blank"), third.alias("third"), ((F.col("n") + 1 == F.col("_size")) & F.col("_open")).alias("open_end"), "wide")


def _issues(lines: DataFrame, key: str, rules: Callable[[str], dict[str, Column]]) -> DataFrame:
    """key, line_no, rule. rules: from a class of blanks; the short one is for texts in which no other blanks stand."""
    narrow, wide = rules(ASCII_BLANK), rules(BLANK)
    found = F.filter(F.array(*[F.when(F.when(F.col("wide"), wide[name]).otherwise(narrow[name]), F.lit(name)) for name in wide]), lambda x: x.isNotNull())
    return lines.select(key, "line_no", F.explode_outer(found).alias("rule")).filter("rule is not null")


def _ends_blank(x: Column, blank: str) -> Column:
    return ~F.col("blank") & F.rlike(F.substring(x, -1, 1), F.lit(blank))


def lint_python(files: DataFrame, key: str, text: str) -> DataFrame:
    """key, line_no, rule: long lines, blanks at the end, tabs in the indent, runs of blanks, blank lines in threes, no line break at the end."""
    x = F.col("line")

    def rules(blank: str) -> dict[str, Column]:
        body, solid = F.regexp_replace(x, f"^{blank}+", ""), blank.replace("[", "[^", 1)
        return {
            "E501": F.length(x) > MAX_LINE,
            "W291": _ends_blank(x, blank),
            "W191": F.rlike(x, F.lit(f"^{blank}*\t{blank}*{solid}")),
            "E221": F.rlike(x, F.lit(f"{blank}{{2}}")) & F.rlike(body, F.lit(f"{solid.replace('[^', '[^:', 1)}{blank}{{2,}}{solid.replace('[^', '[^#', 1)}")) & ~F.rlike(body, F.lit('^[#"]')),
            "E303": F.col("third"),
            "W292": F.col("open_end"),
        }

    return _issues(numbered_lines(files, key, text), key, rules)


def lint_java(files: DataFrame, key: str, text: str) -> DataFrame:
    """The same for Java: also blanks after commas and before braces."""
    x = F.col("line")

    def rules(blank: str) -> dict[str, Column]:
        body, solid = F.regexp_replace(x, f"^{blank}+|{blank}+$", ""), blank.replace("[", "[^", 1)
        return {
            "GJL001": F.length(x) > MAX_LINE,
            "GJL002": _ends_blank(x, blank),
            "GJL003": F.rlike(x, F.lit(f"^{blank}*\t{blank}*{solid}")),
            "GJL004": F.rlike(x, F.lit("[;,]")) & F.rlike(body, F.lit(f"[;,]{solid}")) & ~F.startswith(body, F.lit("//")),
            "GJL005": F.contains(x, F.lit("{")) & F.rlike(body, F.lit(f"[){WORD}]\\{{")) & ~F.rlike(body, F.lit("^(//|\\*|[\"'])")),
            "GJL006": F.col("third"),
            "GJL007": F.col("open_end"),
        }

    return _issues(numbered_lines(files, key, text), key, rules)


def shown_issues(issues: DataFrame, key: str, most: int = SHOWN) -> DataFrame:
    """The first issues of each file by line and rule, and how many more there are (a row without line)."""
    w = Window.partitionBy(key).orderBy("line_no", "rule")
    ranked = issues.withColumns({"n": F.row_number().over(w), "total": F.count("*").over(Window.partitionBy(key))})
    first = ranked.filter(F.col("n") <= most).select(key, "line_no", "rule", F.lit(0).cast("long").alias("more"))
    rest = ranked.filter((F.col("n") == 1) & (F.col("total") > most)).select(key, F.lit(None).cast("int").alias("line_no"), F.lit("more").alias("rule"), (F.col("total") - most).alias("more"))
    return first.unionByName(rest)


_BRANCHES = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.Try, ast.ExceptHandler, ast.With, ast.AsyncWith, ast.Match)
_NESTING = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.Try, ast.With, ast.AsyncWith)


def complexity(node: ast.AST) -> int:
    """1, plus branches, plus operands of `and` and `or` beyond the first."""
    return 1 + sum(isinstance(x, _BRANCHES) + (len(x.values) - 1 if isinstance(x, ast.BoolOp) else 0) for x in ast.walk(node))


def nesting(node: ast.AST) -> int:
    """How deep conditions, loops, try and with statements stand in each other."""
    return max((isinstance(x, _NESTING) + nesting(x) for x in ast.iter_child_nodes(node)), default=0)


MEASURES = "relative_path string, name string, kind string, line int, length int, complexity int, depth int, parameters int, marks string"


def _measure(f) -> list[tuple]:
    out = []
    for node in ast.walk(ast.parse(f.content)):
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            length, c, d = node.end_lineno - node.lineno + 1, complexity(node), nesting(node)
            parameters = len(node.args.args) if hasattr(node, "args") else 0
            marks = ["high" if c > 10 else "raised"] * (c > 5) + ["deep"] * (d > 4) + ["long"] * (length > 50) + ["many"] * (parameters > 5)
            out.append((f.relative_path, node.name, "class" if isinstance(node, ast.ClassDef) else "function", node.lineno, length, c, d, parameters, ",".join(marks or ["good"])))
    return out


def measures(files: DataFrame) -> DataFrame:
    """Length, complexity, nesting and parameters of every Python function and class (relative_path, content)."""
    return files.select("relative_path", "content").filter("content is not null").mapInPandas(_per_file(_measure, MEASURES), MEASURES)


ANNOTATIONS = "relative_path string, name string, line int, missing string"


def _unannotated(f) -> list[tuple]:
    out = []
    for node in ast.walk(ast.parse(f.content)):
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            names = [a.arg for a in node.args.args if a.annotation is None and a.arg not in ("self", "cls")]
            names += ["return"] * (node.returns is None and node.name != "__init__")
            out += [(f.relative_path, node.name, node.lineno, n) for n in names]
    return out


def missing_annotations(files: DataFrame) -> DataFrame:
    return files.select("relative_path", "content").filter("content is not null").mapInPandas(_per_file(_unannotated, ANNOTATIONS), ANNOTATIONS)


def input_error(source: Column, language: Column, most: int = 100_000) -> Column:
    """EMPTY_INPUT, INPUT_TOO_LARGE, UNSUPPORTED_LANGUAGE, INVALID_PYTHON or INVALID_JAVA, the first that holds, or null."""

    @F.pandas_udf("boolean")
    def valid(text: pd.Series, kind: pd.Series) -> pd.Series:
        def one(t, k):
            if t is None or k not in ("python", "java"):
                return True
            if k == "java":
                return braces_balanced(t)
            try:
                ast.parse(t)
            except (SyntaxError, ValueError, RecursionError):
                return False
            return True

        return pd.Series([one(t, k) for t, k in zip(text, kind)])

    kind = F.lower(language)
    return (
        F.when(source.isNull() | (F.trim(source) == ""), "EMPTY_INPUT")
        .when(F.length(source) > most, "INPUT_TOO_LARGE")
        .when(~kind.isin("python", "java"), "UNSUPPORTED_LANGUAGE")
        .when(~valid(source, kind), F.concat(F.lit("INVALID_"), F.upper(kind)))
    )


def split_rows(before: str, after: str) -> list[tuple]:
    """Aligned rows (tag, left line number, left, right line number, right) of two texts."""
    a, b = before.split("\n"), after.split("\n")
    out = []
    for tag, i1, i2, j1, j2 in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
        for k in range(max(i2 - i1, j2 - j1)):
            left, right = i1 + k < i2, j1 + k < j2
            out.append((tag, i1 + k + 1 if left else None, a[i1 + k] if left else None, j1 + k + 1 if right else None, b[j1 + k] if right else None))
    return out


DIFF = "array<struct<tag:string,left_no:int,left:string,right_no:int,right:string>>"


def split_diff(before: Column, after: Column) -> Column:
    """split_rows of two columns."""

    @F.pandas_udf(DIFF)
    def rows(a: pd.Series, b: pd.Series) -> pd.Series:
        names = ("tag", "left_no", "left", "right_no", "right")
        return pd.Series([[dict(zip(names, r)) for r in split_rows(x or "", y or "")] for x, y in zip(a, b)])

    return rows(before, after)


def diff_counts(rows: Column) -> dict[str, Column]:
    """Inserted, deleted and equal rows; a replaced one counts as both inserted and deleted."""
    n = lambda *tags: F.size(F.filter(rows, lambda r: r["tag"].isin(*tags)))
    return {"inserted": n("insert", "replace"), "deleted": n("delete", "replace"), "equal": n("equal")}


def insert_docstring(source: str, line: int, text: str) -> str:
    """Python source with a docstring put into (or replaced in) the function or class that starts at a line; raises if the result isn't Python."""
    node = next(n for n in ast.walk(ast.parse(source)) if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)) and n.lineno == line)
    lines, first = source.split("\n"), node.body[0]
    indent = " " * first.col_offset if first.lineno != node.lineno else " " * (node.col_offset + 4)
    safe = re.sub(r'"(?="")|"$', r'\\"', text.replace("\\", "\\\\"))
    quoted = f'"""{safe}"""'.split("\n")
    block = [indent + x if x else x for x in quoted]
    has = ast.get_docstring(node, clean=False) is not None
    if first.lineno == node.lineno:  # body on the line of the head
        head = lines[line - 1]
        cut = first.col_offset
        lines[line - 1 : line] = [head[:cut].rstrip(), *block, *([] if has else [indent + head[cut:]])]
    elif has:
        lines[first.lineno - 1 : first.end_lineno] = block
    else:
        start = min([first.lineno, *(d.lineno for d in getattr(first, "decorator_list", []))])
        lines[start - 1 : start - 1] = block
    out = "\n".join(lines)
    ast.parse(out)
    return out


def insert_javadoc(source: str, line: int, text: str) -> str:
    """Java source with a documentation comment above a line, in place of one that stands there."""
    lines = source.split("\n")
    at = line - 1
    indent = re.match(r"\s*", lines[at])[0]
    while at > 0 and lines[at - 1].strip().startswith("@"):
        at -= 1
    first = at
    if at > 0 and lines[at - 1].strip().endswith("*/"):
        first = at - 1
        while first > 0 and "/**" not in lines[first]:
            first -= 1
        if "/**" not in lines[first]:
            first = at
    block = [indent + "/**", *[f"{indent} * {x}".rstrip() for x in text.replace("*/", "*&#47;").split("\n")], indent + " */"]
    lines[first:at] = block
    out = "\n".join(lines)
    if not braces_balanced(out):
        raise ValueError("braces aren't balanced")
    return out


def outline(symbols: DataFrame) -> DataFrame:
    """relative_path, parent, children: names in order of lines; the parent of a symbol is its name's longest prefix that is a class (null at the top)."""
    c, p = symbols.alias("c"), symbols.filter("kind = 'class'").alias("p")
    on = (F.col("c.relative_path") == F.col("p.relative_path")) & (F.regexp_replace("c.qualified_name", r"\.?[^.]*$", "") == F.col("p.qualified_name"))
    linked = c.join(p, on, "left").select("c.relative_path", F.col("p.qualified_name").alias("parent"), "c.name", "c.start_line").distinct()
    return linked.groupBy("relative_path", "parent").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start_line", "name"))), lambda x: x["name"]), ", ").alias("children"))


def api_docs(entries: DataFrame) -> DataFrame:
    """relative_path and its documentation: a table of contents, then a section for each entry (relative_path, name, slug, text, line)."""
    item = F.struct("line", F.concat(F.lit("- ["), "name", F.lit("](#"), "slug", F.lit(")")).alias("toc"), F.concat(F.lit("## "), "name", F.lit("\n\n"), F.coalesce("text", F.lit(""))).alias("section"))
    whole = entries.groupBy("relative_path").agg(F.sort_array(F.collect_list(item)).alias("items"))
    return whole.select("relative_path", F.concat(F.array_join(F.transform("items", lambda x: x["toc"]), "\n"), F.lit("\n\n"), F.array_join(F.transform("items", lambda x: x["section"]), "\n\n")).alias("document"))


def slugs(rows: DataFrame, group: list[str], name: str, order: str, prefix: str = "") -> DataFrame:
    """Adds `slug`: the name's own, or with the first of -2, -3 and so on that no row before it in its group (in `order`) has.

    Groups are sorted within partitions and stream by; only the slugs of the current group are held.
    """
    from codeloom.functions.text import slug as plain

    based = rows.withColumn("slug", plain(F.col(name), prefix))
    names = based.columns
    at = [names.index(g) for g in group]

    def numbered(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, used, following = None, set(), {}
        for batch in frames:
            keys = list(zip(*(batch.column(k).to_pylist() for k in at))) if at else [()] * batch.num_rows
            out = []
            for key, base in zip(keys, batch.column("slug").to_pylist()):
                if key != current:
                    current, used, following = key, set(), {}
                got = base
                if got in used:
                    n = following.get(base, 2)
                    while f"{base}-{n}" in used:
                        n += 1
                    got, following[base] = f"{base}-{n}", n + 1
                used.add(got)
                out.append(got)
            yield batch.set_column(names.index("slug"), "slug", pa.array(out, pa.string()))

    return based.repartition(*group).sortWithinPartitions(*group, order).mapInArrow(numbered, based.schema)


def refresh_entries(entries: DataFrame, symbols: DataFrame) -> DataFrame:
    """Documentation entries (id, base, ordinal, text) with the code of their symbol (id, base, ordinal, code): by id, else the entry's place among those of the same base."""
    exact = symbols.select("id", F.col("code").alias("_exact"))
    nth = symbols.select("base", "ordinal", F.col("code").alias("_nth"))
    return entries.join(exact, "id", "left").join(nth, ["base", "ordinal"], "left").withColumn("code", F.coalesce("_exact", "_nth")).drop("_exact", "_nth")


def batch_outcome(has_result: Column, errors: Column, cancelled: Column) -> Column:
    """FAILED, CANCELLED_WITH_RESULTS, PARTIAL or SUCCEEDED."""
    return F.when(~has_result, "FAILED").when(cancelled, "CANCELLED_WITH_RESULTS").when(errors > 0, "PARTIAL").otherwise("SUCCEEDED")


def log_head(log: Column, lines: int = 6) -> Column:
    return F.array_join(F.slice(F.split(log, "\n"), 1, lines), "\n")


def facade(files: DataFrame) -> dict[str, DataFrame]:
    """The reports of a set of Python and Java files (project_id, relative_path, language, content), by name: measures and annotations of Python, style rules, symbols, outlines and input errors of both."""
    from codeloom.operators.parsing import symbols

    python, java = (files.filter(F.lower("language") == name) for name in ("python", "java"))
    issues = lint_python(python, "relative_path", "content").unionByName(lint_java(java, "relative_path", "content"))
    found = symbols(files)
    return {
        "measures": measures(python),
        "annotations": missing_annotations(python),
        "lint": shown_issues(issues, "relative_path"),
        "symbols": found,
        "outline": outline(found),
        "errors": files.select("relative_path", input_error(F.col("content"), F.col("language")).alias("error")).filter("error is not null"),
    }
