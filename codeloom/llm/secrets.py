"""Secret scan with corpus-wide ownership frequency, by DataFrame functions only.

Base spans come from three patterns. Further candidates are long mixed tokens anywhere else. The hashes of
all candidate values are counted over the corpus: in how many repositories (documents) and by how many owners
(sources) each occurs. A value that few owners have, in few repositories, and that doesn't look made up is taken for a
live credential; one that many owners have, or that one owner has copied into many repositories, is an example. Live
tokens outside the base spans are added as spans of kind `owner`; base spans always stay, and are counted as live or copied.

Counts are summed per value and owner before they are shuffled by value, so an example that a third of the
corpus holds is one row of each task. What is joined back to the documents is keyed by id and text hash
and never holds their text.

Null and empty texts have no spans. Documents with the same id and text get the same result, one row each. A
null source counts as one owner, and so does a table without that column. Only doc_id, text and source are read,
whatever else the table has. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._tables import written
from .spans import match_spans

#: Fixed values of the contract: kinds in order, pattern, least length (of group 2 for assign).
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST = {"assign": 12, "access": 18, "hex": 16}
KINDS = ("assign", "access", "hex", "owner")

#: Further candidates: tokens of this form with a digit and two kinds of letter, or a digit and a sign.
TOKEN = r"[A-Za-z0-9+/_=-]{24,}"
#: No span of any kind is in a text without this: a cheap test before the patterns.
NEEDS = "[0-9:=]|AKIA|[a-f]{%d}" % LEAST["hex"]
#: A value that more owners have is an example.
MAX_OWNERS = 2
#: So is a value in more repositories, whoever owns them.
MAX_REPOSITORIES = 20
#: Values with these words, or that repeat one character often, are made up.
MADE_UP = r"(?i)(example|sample|changeme|placeholder|dummy|your_|xxxx|1234567890|(.)\2{7,})"
REDACTED = "[SECRET]"


def _tagged(spans: Column, kind: str, value) -> Column:
    return F.transform(
        spans,
        lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("order"), s["end"].alias("end"), F.lit(kind).alias("kind"), F.sha2(value(s), 256).alias("hash"), F.rlike(value(s), F.lit(MADE_UP)).alias("made_up")),
    )


def base_spans(text: Column) -> Column:
    """All base spans by start, then kind."""
    # runs shorter than the least length can be left out by the pattern where that changes no other match
    assign = F.filter(match_spans(text, ASSIGN), lambda s: F.length(F.regexp_extract(s["value"], ASSIGN, 2)) >= LEAST["assign"])
    access = match_spans(text, ACCESS[:-1] + "{%d,}" % (LEAST["access"] - 4))
    hexes = match_spans(text, HEX[:-1] + "{%d,}" % LEAST["hex"])
    return F.array_sort(
        F.concat(
            _tagged(assign, "assign", lambda s: F.regexp_extract(s["value"], ASSIGN, 2)),
            _tagged(access, "access", lambda s: s["value"]),
            _tagged(hexes, "hex", lambda s: s["value"]),
        )
    )


def _where_needed(text: Column, spans: Column) -> Column:
    none = F.array().cast("array<struct<start:bigint,order:int,end:bigint,kind:string,hash:string,made_up:boolean>>")
    return F.when(F.rlike(text, F.lit(NEEDS)), spans).otherwise(none)


def _mixed(value: Column) -> Column:
    has = lambda p: F.rlike(value, F.lit(p)).cast("int")
    return (has("[0-9]") == 1) & (has("[a-z]") + has("[A-Z]") + has("[+/_=-]") >= 2)


def find_secrets(docs: DataFrame, max_owners: int = MAX_OWNERS, max_repositories: int = MAX_REPOSITORIES) -> DataFrame:
    """doc_id, text_hash, and spans as array<struct<start, order, end, kind, hash, made_up, live>> of each document."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    owner = F.col("source").cast("string") if "source" in docs.columns else F.lit(None).cast("string")
    found = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64("text").alias("text_hash"),
        F.coalesce(owner, F.lit("")).alias("owner"),
        _where_needed(text, base_spans(text)).alias("base"),
        _where_needed(text, _tagged(F.filter(match_spans(text, TOKEN), lambda s: _mixed(s["value"])), "owner", lambda s: s["value"])).alias("tokens"),
    )
    # candidates of the documents that have any: few and short
    overlaps = lambda t: F.exists("base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"]))
    found = found.withColumn("spans", F.concat("base", F.filter("tokens", lambda t: ~overlaps(t)))).drop("base", "tokens")
    # read three times below: written once, without texts, so that the patterns run once
    found, _ = written(found, "secrets")
    values = found.filter(F.size("spans") > 0).select("doc_id", "text_hash", "owner", F.explode(F.array_distinct(F.transform("spans", lambda s: s["hash"]))).alias("hash"))
    by_owner = values.groupBy("hash", "owner").agg(F.count("*").alias("repositories"))
    frequency = by_owner.groupBy("hash").agg(F.count("*").alias("owners"), F.sum("repositories").alias("repositories"))
    live = frequency.filter((F.col("owners") <= max_owners) & (F.col("repositories") <= max_repositories)).select("hash")
    kept = values.join(live, "hash", "left_semi").groupBy("doc_id", "text_hash").agg(F.collect_set("hash").alias("live"))
    left, right = found.alias("l"), kept.alias("r")
    same = F.col("l.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("l.text_hash") == F.col("r.text_hash"))
    is_live = lambda s: F.coalesce(F.array_contains("live", s["hash"]), F.lit(False)) & ~s["made_up"]
    return (
        left.join(right, same, "left")
        .select("l.doc_id", "l.text_hash", "l.spans", "r.live")
        .withColumn("spans", F.transform("spans", lambda s: s.withField("live", is_live(s))))
        .select("doc_id", "text_hash", F.array_sort(F.filter("spans", lambda s: (s["kind"] != "owner") | s["live"])).alias("spans"))
    )


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_counts(docs: DataFrame, max_owners: int = MAX_OWNERS, max_repositories: int = MAX_REPOSITORIES) -> DataFrame:
    """One row per document: base counts, their digest, all spans as a string, and how many are live or copied."""
    n = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return find_secrets(docs, max_owners, max_repositories).select(
        "doc_id",
        n("assign").alias("n_assign"),
        n("access").alias("n_access"),
        n("hex").alias("n_hex"),
        F.sha2(_listed(F.filter("spans", lambda s: s["kind"] != "owner")), 256).alias("base_sha256"),
        _listed(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: s["live"])).cast("long").alias("n_live"),
        F.size(F.filter("spans", lambda s: ~s["live"])).cast("long").alias("n_copied"),
    )


def may_hold_secrets(text: Column) -> Column:
    """Whether a text has anything that a span could start from."""
    return F.coalesce(F.rlike(text, F.lit(NEEDS)) & F.regexp_like(text, F.lit(f"{ASSIGN}|{ACCESS[:-1]}{{{LEAST['access'] - 4},}}|{HEX[:-1]}{{{LEAST['hex']},}}|{TOKEN}")), F.lit(False))


def redact(docs: DataFrame, max_owners: int = MAX_OWNERS, max_repositories: int = MAX_REPOSITORIES) -> DataFrame:
    """The input with every span's text replaced; other documents and columns as they were. Only texts that may hold secrets meet their spans in a join."""
    spans = find_secrets(docs, max_owners, max_repositories).filter(F.size("spans") > 0).select("doc_id", "text_hash", F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))).alias("spans")).distinct()
    loud = may_hold_secrets(F.col("text").cast("string"))
    left, right = docs.filter(loud).alias("l"), spans.alias("r")
    same = F.col("l.doc_id").cast("long").eqNullSafe(F.col("r.doc_id")) & (F.xxhash64("l.text") == F.col("r.text_hash"))
    text = F.col("l.text")

    def step(state: Column, s: Column) -> Column:
        # spans that overlap or touch the one before make one
        joins = s["start"] < state["at"]
        gap = F.struct(state["at"].alias("from"), s["start"].alias("to"))
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), F.when(joins, state["gaps"]).otherwise(F.concat(state["gaps"], F.array(gap))).alias("gaps"))

    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<from:bigint,to:bigint>>").alias("gaps"))
    cut = lambda lo, size: text.substr(lo.cast("int") + 1, size.cast("int"))
    done = F.aggregate(
        "r.spans", start, step, lambda s: F.concat(F.array_join(F.transform(s["gaps"], lambda g: F.concat(cut(g["from"], g["to"] - g["from"]), F.lit(REDACTED))), ""), cut(s["at"], F.length(text)))
    )
    redacted = left.join(right, same, "left").select(*[F.when(F.col("r.spans").isNotNull(), done).otherwise(text).alias(c) if c == "text" else F.col(f"l.{c}") for c in docs.columns])
    return docs.filter(~loud).unionByName(redacted)
