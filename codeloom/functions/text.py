"""Text expressions: tokens, normalisation, identities, predicates."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed patterns: words, operators, places where an identifier is cut.
WORD = r"[\p{L}\p{N}]+(?:_[\p{L}\p{N}]+)*"
OPERATOR = r"==|!=|<=|>=|->|//|\*\*|&&|\|\||<<|>>|[+\-*/%=<>!&|^~]"
CASE_CUT = r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])|(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])"
#: What stands between words, and between the parts of a word, while a text is cut; neither is ever in a word.
_NEXT, _CUT = "\x01", "\x02"


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value worked out once."""
    return F.transform(F.array(value), then)[0]


@lru_cache(maxsize=1)
def _folding() -> tuple[str, str, dict[str, str]]:
    """What case folding does beyond lower case, by Python's rule: letters that become another one, in order, and those that become several."""
    one, many = {}, {}
    for c in map(chr, range(0x20000)):
        low, folded = c.lower(), c.casefold()
        if folded != low and len(low) == 1 and low not in one and low not in many:
            (one if len(folded) == 1 else many)[low] = folded
    return "".join(one), "".join(one.values()), many


def fold(text: Column) -> Column:
    """Case folding: lower case, and the letters that fold further; the two common ones by plain replacement, others sign by sign."""
    from_, to, many = _folding()
    common = {"ß": "ss", "ς": "σ"}
    rest = sorted(c for c in (*from_, *many) if c not in common)
    # a class of many letters is slow: texts in Latin letters pass by a short one
    late = [c for c in rest if c >= "\u0300"]
    may, has = f"[{''.join(c for c in rest if c < late[0])}{late[0]}-{late[-1]}]", f"[{''.join(rest)}]"

    def further(low: Column) -> Column:
        wide = F.create_map(*[F.lit(x) for pair in many.items() for x in pair])
        signs = F.split(F.translate(low, from_, to), "")
        return F.when(F.rlike(low, F.lit(may)) & F.rlike(low, F.lit(has)), F.array_join(F.transform(signs, lambda c: F.coalesce(F.try_element_at(wide, c), c)), "")).otherwise(low)

    low = F.lower(text)
    for c, other in common.items():
        low = F.replace(low, F.lit(c), F.lit(other))
    return let(low, further)


def tokens(text: Column) -> Column:
    """Index tokens of a text or query: each word folded, followed by its folded parts that differ from it; then the operators.

    Words are joined into one string, which is cut and folded as a whole.
    """
    none = F.array().cast("array<string>")

    def parted(both: Column) -> Column:
        word = lambda w, p: F.when(w == p, F.array(w)).otherwise(F.concat(F.array(w), F.filter(F.split(p, _CUT), lambda x: (x != "") & (x != w))))
        whole, parts = F.split(both["whole"], _NEXT), F.split(both["parts"], _NEXT)
        return F.when(both["whole"] == both["parts"], whole).otherwise(F.flatten(F.zip_with(whole, parts, word)))

    def cut(joined: Column) -> Column:
        return let(F.regexp_replace(joined, f"_|{CASE_CUT}", _CUT), lambda p: let(F.struct(fold(joined).alias("whole"), F.when(p == joined, fold(joined)).otherwise(fold(p)).alias("parts")), parted))

    joined = F.array_join(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), _NEXT)
    words = let(joined, lambda j: F.when(j == "", none).otherwise(cut(j)))
    return F.concat(words, F.regexp_extract_all(text, F.lit(OPERATOR), F.lit(0)))


def normalise_lf(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n?", "\n")


def decode_source(content: Column) -> Column:
    """Bytes as UTF-8 with replacement characters and LF line ends."""
    return normalise_lf(F.decode(content, "UTF-8"))


def physical_lines(text: Column) -> Column:
    """Lines cut at LF, CRLF and CR only."""
    return F.split(text, "\r\n|\r|\n", -1)


def slashes(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def is_host_path(path: Column) -> Column:
    """An absolute POSIX path, or one with a drive."""
    return F.rlike(path, F.lit(r"^(/|[A-Za-z]:[\\/])"))


def strict_path_error(path: Column) -> Column:
    """Why a relative path isn't acceptable, or null."""
    p = slashes(path)
    return (
        F.when(path.isNull() | (path == ""), "empty")
        .when(F.startswith(p, F.lit("/")) | F.startswith(p, F.lit("~/")), "absolute")
        .when(F.rlike(p, F.lit(r"^\.\.?$|^\.\./|/\.\.(/|$)")) | (p == "."), "traversal")
    )


def strict_path(path: Column) -> Column:
    """The path with forward slashes, without empty or `.` steps; raises for others than relative ones."""
    clean = F.regexp_replace(F.regexp_replace(F.regexp_replace(slashes(path), "/+", "/"), r"(^|/)(\./)+", "$1"), r"/\.?$", "")
    error = strict_path_error(path)
    return F.when(error.isNotNull(), F.raise_error(F.concat(F.lit("relative path: "), error)).cast("string")).otherwise(clean)


def python_module(path: Column) -> Column:
    """Dotted module name of a Python file."""
    return F.replace(F.regexp_replace(F.regexp_replace(path, r"\.py$", ""), "(^|/)__init__$", ""), F.lit("/"), F.lit("."))


def canonical_import(target: Column, importer: Column) -> Column:
    """An import with leading dots resolved against the importer's package; too many dots make it unresolved."""
    level = F.length(F.regexp_extract(target, r"^(\.*)", 1))
    suffix = F.regexp_replace(target, r"^\.+", "")
    parts = F.filter(F.split(python_module(importer), r"\."), lambda p: p != "")
    package = F.when(F.endswith(importer, F.lit("/__init__.py")), parts).otherwise(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))))
    n, trim = F.size(package), level - 1
    name = F.array_join(package, ".")
    unresolved = F.concat_ws(":", F.lit("unresolved-relative"), F.when(name == "", "<root>").otherwise(name), level.cast("string"), F.when(suffix == "", "*").otherwise(suffix))
    base = F.slice(package, 1, F.greatest(n - trim, F.lit(0)))
    resolved = F.concat_ws(".", F.when(F.size(base) > 0, F.array_join(base, ".")), F.when(suffix != "", suffix))
    return F.when(level == 0, target).when((n == 0) | (trim >= n), unresolved).otherwise(resolved)


def output_name(path: Column, strategy: str = "suffix") -> Column:
    """Where an annotated copy goes: `same`, `suffix` (name_annotated.ext) or `subdir` (annotated/path)."""
    if strategy == "same":
        return path
    if strategy == "subdir":
        return F.concat(F.lit("annotated/"), path)
    return F.when(F.rlike(path, F.lit(r"[^/]\.[^./]+$")), F.regexp_replace(path, r"(\.[^./]+)$", "_annotated$1")).otherwise(F.concat(path, F.lit("_annotated")))


def file_identity(path: Column) -> Column:
    return F.concat_ws(":", F.lit("file"), path)


def chunk_identity(path: Column, start: Column, end: Column) -> Column:
    return F.concat_ws(":", F.lit("chunk"), path, start.cast("string"), end.cast("string"))


def symbol_text(language: Column, path: Column, name: Column, kind: Column, disambiguator: Column, line: Column) -> Column:
    """A symbol's key on one line; null parts are left out."""
    return F.concat_ws(":", language, path, name, kind, disambiguator, F.when(line.isNotNull(), F.concat(F.lit("line:"), line.cast("string"))))


def slug(name: Column, prefix: str = "") -> Column:
    """The prefix, then letters, digits, `_` and `-` in lower case, runs of others as one `-`, without `-` and `_` at the ends; names without any become `item-unknown`, missing ones `item`."""
    some = F.when(F.coalesce(name, F.lit("")) == "", "item").otherwise(name)
    base = F.lower(F.regexp_replace(F.regexp_replace(some, "[^A-Za-z0-9_-]+", "-"), "^[-_]+|[-_]+$", ""))
    return F.concat(F.lit(prefix), base) if prefix else F.when(base == "", "item-unknown").otherwise(base)


def needs_translation(text: Column, target: str) -> Column:
    """Whether a text isn't yet in English (`en`), Chinese (`zh`) or Japanese (`ja`), by its characters."""
    cjk = F.rlike(text, F.lit("[一-鿿]"))
    kana = F.rlike(text, F.lit("[぀-ヿ]"))
    rule = {"en": cjk | kana, "zh": kana | ~cjk, "ja": ~kana}.get(target, F.lit(False))
    return F.coalesce((text != "") & rule, F.lit(False))


#: Fixed patterns of fields and values that look like credentials.
CREDENTIAL_NAME = r"(?:credential|password|passwd|secret|api[_-]?key|access[_-]?token|auth[_-]?token|authorization|private[_-]?key)"
CREDENTIAL_VALUE = (
    r"(?i)(?:sk-(?:proj-)?[A-Za-z0-9_-]{12,}|Bearer\s+[A-Za-z0-9._~+/=-]{12,}|AKIA[A-Z0-9]{16}"
    r"|-----BEGIN [A-Z ]*PRIVATE KEY-----|SECRET_MARKER|SOURCE_MARKER)"
)
CREDENTIAL_ASSIGNMENT = r"(?i)\b" + CREDENTIAL_NAME + r"\b\s*[\"']?\s*[:=]\s*[\"']?[^\s\"',;}]+"


def has_credential(text: Column) -> Column:
    return F.rlike(text, F.lit(CREDENTIAL_VALUE)) | F.rlike(text, F.lit(CREDENTIAL_ASSIGNMENT))


def private_entry(entries: Column) -> Column:
    """Whether a map<string,string> has a key or value that looks like a credential."""
    return F.exists(F.map_entries(entries), lambda e: F.rlike(e["key"], F.lit("(?i)" + CREDENTIAL_NAME)) | has_credential(e["key"]) | F.coalesce(has_credential(e["value"]), F.lit(False)))


#: Fixed patterns of model output that must not be used.
UNSAFE_OUTPUT = (
    r"traceback\s*\(",
    r"\bsystem prompt\b",
    r"\bapi[_ -]?key\s*[:=]",
    r"\bsk-[A-Za-z0-9_-]{8,}",
    r"(?:^|\s)/(?:Users|home|private|var)/[^\s]+",
    r"\b(?:run|execute) (?:this )?(?:command|tool)\b",
)
EXTRA_PROSE = r"^\s*(?:here (?:is|are)|sure[,!:]|certainly[,!:])"


def output_error(text: Column) -> Column:
    """EMPTY_RESPONSE, UNSAFE_RESPONSE, EXTRA_PROSE or null, the first that holds."""
    unsafe = F.lit(False)
    for p in UNSAFE_OUTPUT:
        unsafe = unsafe | F.rlike(text, F.lit("(?i)" + p))
    return F.when(text.isNull() | (F.trim(text) == ""), "EMPTY_RESPONSE").when(unsafe, "UNSAFE_RESPONSE").when(F.rlike(text, F.lit("(?i)" + EXTRA_PROSE)), "EXTRA_PROSE")


def neutralise(text: Column, tag: str = "SOURCE_CODE") -> Column:
    """A prompt's own tags inside a text become brackets."""
    text = F.replace(F.coalesce(text, F.lit("")), F.lit(f"<{tag}>"), F.lit(f"[{tag}]"))
    return F.replace(text, F.lit(f"</{tag}>"), F.lit(f"[/{tag}]"))


FENCED = r"^\s*```[A-Za-z0-9_+-]*\s*\n([\s\S]*?)\n```\s*$"


def strip_fence(text: Column) -> Column:
    """The text without its one code fence; null if the fences don't make one pair around all of it."""
    n = F.regexp_count(text, F.lit("```"))
    return F.when(n == 0, F.trim(text)).when((n == 2) & F.rlike(text, F.lit(FENCED)), F.trim(F.regexp_extract(text, FENCED, 1)))


def javadoc_text(comment: Column) -> Column:
    """The words of a /** */ comment, line by line, without its marks."""
    body = F.regexp_replace(F.regexp_replace(F.trim(comment), r"^/\*\*", ""), r"\*/$", "")
    lines = F.transform(F.split(body, "\n"), lambda x: F.trim(F.regexp_replace(F.trim(x), r"^\*+ ?", "")))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def lookup(table: dict[str, dict[str, str]], key: Column, language: Column, fallback: str = "中文") -> Column:
    """A text of a two-level table; the fallback language, then the key itself, where there is none."""
    flat = [F.lit(x) for k, by in table.items() for lang, said in by.items() for x in (f"{k}\n{lang}", said)]
    texts = F.create_map(*flat)
    at = lambda lang: F.try_element_at(texts, F.concat_ws("\n", key, lang))
    return F.coalesce(at(language), at(F.lit(fallback)), key)
