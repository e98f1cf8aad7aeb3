"""Merge-type subword encoding by a table of last tokens, and decoding.

A merge-type vocabulary joins the adjacent pair whose union has the best score until no pair is left.
Every prefix of a text then has exactly one last token: the piece that ends there, encodes to itself,
and is compatible with the last token of the prefix before it, which means that the two pieces put
together encode to just these two. An automaton lists the pieces that end at each place; compatibility
is tested once for each pair and remembered. The ids of the whole text are read backwards from its
last prefix. Characters that are no piece keep everything apart and become byte pieces.

No piece has a space mark behind another character, so a text falls into parts, a run of spaces and what
follows up to the next space, that don't influence each other; a line break is a part of its own if no longer
piece holds it, and a part ends between a letter and another sign if no piece holds two such neighbours. Parts
repeat, so each worker keeps what it has encoded, up to `CACHE_PARTS` parts, and starts anew beyond that. Each text
is encoded alone and whole: nothing is shuffled.

Null and empty texts have no ids and decode to the empty text. Repeated rows give repeated results.
Only the id and the text are read, whatever else the input has.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
#: A cache of encoded parts is emptied at so many entries or characters; longer parts are not remembered.
CACHE_PARTS = 200_000
CACHE_CHARS = 8_000_000
CACHE_LONGEST = 1_000
CACHE_PAIRS = 1_000_000
UNKNOWN = -1


class PieceTable:
    """The vocabulary of a model file, and the encoder and decoder over it."""

    def __init__(self, model_path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        n = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(n)]
        self.score: dict[str, float] = {}
        self.id: dict[str, int] = {}
        self.byte_of = {i: int(self.pieces[i][3:5], 16) for i in range(n) if model.is_byte(i)}
        self.byte_id = {b: i for i, b in self.byte_of.items()}
        self.silent = {i for i in range(n) if model.is_control(i)}
        self.unknown_id = model.unk_id()
        self.special = {*self.byte_of, *self.silent, self.unknown_id}
        for i, piece in enumerate(self.pieces):
            if not (i in self.byte_of or i in self.silent or i == self.unknown_id or model.is_unused(i)):
                self.score[piece] = model.get_score(i)
                self.id[piece] = i
        if any(MARK in p.lstrip(MARK) for p in self.id):
            raise ValueError("a piece holds a space mark behind another character")
        # a text gets a space in front unless the model says otherwise; probe instead of reading the file format
        probe = next(p for p in self.id if len(p) == 1 and p != MARK)
        self.front = " " if model.decode(model.encode(probe, out_type=int)) == probe and model.encode(probe, out_type=str)[0].startswith(MARK) else ""
        if model.encode(probe + "  ", out_type=str)[-1].strip(MARK):
            raise ValueError("the model removes spaces; only identity normalisation is supported")
        alone = not any("\n" in p and len(p) > 1 for p in self.id)
        # letters end where others begin, if no piece goes across; word signs that are no letters count as others
        odd = "".join(re.escape(c) for c in sorted({c for p in self.id for c in p}) if c.isalnum() and not c.isalpha())
        letters, others = rf"[^\W\d_{odd}]", rf"(?:[^\w \n]|[\d_{odd}])"
        across = re.compile(f"{letters}{others}|(?!{MARK}){others}{letters}")
        if not alone:
            parts = r" *[^ ]+| +"
        elif any(across.search(p) for p in self.id):
            parts = r" *[^ \n]+| +|\n"
        else:
            parts = rf" *{letters}+| *{others}+| +|\n"
        self.part = re.compile(parts).findall
        # the automaton holds the pieces that encode to themselves; others are never a last token
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.id.items():
            if len(piece) == 1 or self.merge(piece) == [piece]:
                self.automaton.add_word(piece, (i, len(piece)))
        self.automaton.make_automaton()
        self.pairs: dict[int, bool] = {}
        self.done_chars = 0
        # of each id, its decimal text and what it decodes to
        self.decimal = [str(i) for i in range(n)]
        self.said = [p.replace(MARK, " ") for p in self.pieces]
        self.done: dict[str, tuple[int, str, str]] = {}

    def merge(self, text: str) -> list[str]:
        """What joining the best pair again and again makes of a short text; of equal scores the leftmost goes first."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, a: int, b: int) -> bool:
        if len(self.pairs) >= CACHE_PAIRS:
            self.pairs.clear()
        left, right = self.pieces[a], self.pieces[b]
        known = self.pairs[a * len(self.pieces) + b] = self.merge(left + right) == [left, right]
        return known

    def last_tokens(self, part: str) -> tuple[list[int], list[int]]:
        """For each prefix of a part, its last token, and that token's length; UNKNOWN after a character that is no piece."""
        token_at, size_at, fits, base = [UNKNOWN] * (len(part) + 1), [1] * (len(part) + 1), self.pairs.get, len(self.pieces)
        for end, (token, size) in self.automaton.iter(part):
            end += 1
            if token_at[end] >= 0:
                continue
            if end > size:
                before = token_at[end - size]
                if before >= 0:
                    known = fits(before * base + token)
                    if known is None:
                        known = self.compatible(before, token)
                    if not known:
                        continue
            token_at[end], size_at[end] = token, size
        return token_at, size_at

    def encode_part(self, part: str) -> list[int]:
        token_at, size_at = self.last_tokens(part)
        ids, at = [], len(part)
        while at:
            token = token_at[at]
            if token == UNKNOWN:
                ids.extend(self.byte_id.get(b, self.unknown_id) for b in reversed(part[at - 1].encode("utf-8", "surrogatepass")))
            else:
                ids.append(token)
            at -= size_at[at]
        ids.reverse()
        return ids

    def parts(self, text: str) -> list[str]:
        return self.part(self.front + text.replace(MARK, " ")) if text else []

    def encode(self, text: str | None) -> list[int]:
        """All ids of a text, without begin or end."""
        return [i for part in self.parts(text or "") for i in self.encode_part(part.replace(" ", MARK))]

    def encoded(self, part: str) -> tuple[int, str, str]:
        """The number of ids of a part, the ids with commas, and what they decode to; remembered in `done`."""
        ids = self.encode_part(part.replace(" ", MARK))
        decimal = self.decimal
        got = len(ids), ",".join([decimal[i] for i in ids]), self.spell(ids)
        if len(part) <= CACHE_LONGEST:
            self.done_chars += len(part)
            if len(self.done) >= CACHE_PARTS or self.done_chars > CACHE_CHARS:
                self.done.clear()
                self.done_chars = len(part)
            self.done[part] = got
        return got

    def spell(self, ids: list[int]) -> str:
        """The text of ids without the rule for the space in front; bytes that aren't UTF-8 become U+FFFD each."""
        if self.special.isdisjoint(ids):
            said = self.said
            return "".join([said[i] for i in ids])
        out, raw = [], bytearray()
        for i in [*ids, None]:
            if i in self.byte_of:
                raw.append(self.byte_of[i])
                continue
            if raw:
                out.append(_decode_bytes(bytes(raw)))
                raw.clear()
            if i is not None and i not in self.silent:
                out.append(" ⁇ " if i == self.unknown_id else self.pieces[i])
        return "".join(out).replace(MARK, " ")

    def decode(self, ids: list[int]) -> str:
        first = next((i for i in ids if i not in self.silent), None)
        text = self.spell(ids)
        return text[1:] if self.front and first not in self.byte_of and text.startswith(self.front) else text


def _decode_bytes(raw: bytes) -> str:
    """UTF-8 with one U+FFFD for every byte that isn't part of a whole character."""
    out, k = [], 0
    while k < len(raw):
        for size in (1, 2, 3, 4):
            try:
                out.append(raw[k : k + size].decode("utf-8"))
                k += size
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            k += 1
    return "".join(out)


@lru_cache(maxsize=2)
def piece_table(model_path: str) -> PieceTable:
    return PieceTable(model_path)


def digest(table: PieceTable, text: str | None) -> tuple[int, str, str]:
    """Number of ids, digest of the ids, digest of the decoded text."""
    known, encoded = table.done.get, table.encoded
    got = [known(part) or encoded(part) for part in table.parts(text or "")]
    decoded = "".join([x[2] for x in got])
    if table.front and decoded.startswith(table.front):
        decoded = decoded[len(table.front) :]
    return sum([x[0] for x in got]), hashlib.sha256(",".join([x[1] for x in got]).encode()).hexdigest(), hashlib.sha256(decoded.encode("utf-8", "surrogatepass")).hexdigest()


def encode_documents(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, ids and the decoded text of each document. model_path: the same file on every machine."""

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = piece_table(model_path)
        for batch in batches:
            ids = [table.encode(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32())), pa.array([table.decode(x) for x in ids], pa.string())],
                names=["doc_id", "ids", "decoded"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        coded, "doc_id long, ids array<int>, decoded string"
    )


def digest_documents(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encode_documents without its bulk."""

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = piece_table(model_path)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                got = [digest(table, t) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([x[0] for x in got], pa.int64()), *(pa.array([x[k] for x in got], pa.string()) for k in (1, 2))],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        coded, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
