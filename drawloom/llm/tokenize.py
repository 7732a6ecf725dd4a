"""Encoding of texts of any length with a public byte-level BPE tokenizer.

A text is cut by the tokenizer's pattern into pieces that are encoded on their own; nearly all are words. A long piece that the
pattern leaves whole (a run without a space) is encoded by tree concatenation: its halves are halved down to leaves, the leaves
are encoded on their own, and going up the tree each join is mended: a window around it is encoded anew and grows until its first
and last token agree with those of both sides. Then every pair of neighbours in the result occurs in an encoding of its own bytes,
which is what makes a sequence of this tokenizer's tokens the encoding of the whole, so the result is exact. Work is linear in the
length for all but adversarial texts (a window may grow over everything; the result is then just as exact).

A text is always cut as a whole, never a slice of it: the pattern looks ahead, and white space before a slice's end would be cut
otherwise than before the word that follows it. What is sent on is either pieces or a part that ends in no white space, which the
pattern cuts alike with and without what follows.

Texts longer than ``piece_chars`` are sent on in such parts, and their long runs as leaves, so that a very long text is encoded by
many tasks; its parts are joined in order afterwards. Neither that length nor ``long_run`` changes any result.

Defined results: null and empty texts give an empty list. Strings that look like special tokens are ordinary text. Each row gives
one row; repeated rows repeat. The vocabulary file's path is a parameter.
"""

from __future__ import annotations

import base64
import itertools
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drawloom.storage import spread, written

#: Pieces of more bytes than this take the tree; its leaves are at most half as long.
LONG_RUN = 64
#: Texts of more characters than this are spread over tasks.
PIECE_CHARS = 1 << 18
#: Fixed values of the tokenizer: its cutting pattern.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""


def default_vocabulary() -> str:
    """The installed vocabulary of byte_bpe_50k."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class Encoder:
    """Exact encodings, with trees for long runs."""

    def __init__(self, path: str, long_run: int = LONG_RUN):
        import regex
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.enc = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.long_run = long_run
        self.cut = regex.compile(PATTERN)
        self.blanks = re.compile(r"\s{%d,}" % max(1, long_run // 4))
        #: trees built, joins made in them, and windows that had to grow
        self.trees = self.joins = self.grown = 0

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        if not self.may_have_long(text):
            return self.enc.encode_ordinary(text)
        out: list[int] = []
        for m in self.cut.finditer(text):
            out += self.piece(m.group().encode())
        return out

    def may_have_long(self, text: str) -> bool:
        """Whether some piece may be longer than ``long_run``: a word with its space before it, white space, or signs that split() takes for white space."""
        n = self.long_run
        if any(len(w) * 4 >= n and len(w.encode()) >= n for w in text.split()):
            return True
        return any(c in text for c in "\x1c\x1d\x1e\x1f") or self.blanks.search(text) is not None

    def piece(self, raw: bytes) -> list[int]:
        """One piece of the pattern's."""
        if len(raw) <= self.long_run:
            return self.whole(raw)
        self.trees += 1
        return self.tree(raw)

    def whole(self, raw: bytes) -> list[int]:
        return self.enc._encode_single_piece(raw) if raw else []

    def tree(self, raw: bytes) -> list[int]:
        """A run, by halves."""
        if len(raw) <= self.long_run // 2:
            return self.whole(raw)
        mid = len(raw) // 2
        return self.join(self.tree(raw[:mid]), self.tree(raw[mid:]))

    def join(self, left: list[int], right: list[int], width: int = 4) -> list[int]:
        """The encoding of the bytes of two encodings one after the other, within one run."""
        if not left or not right:
            return left + right
        self.joins += 1
        size = self.enc.decode_single_token_bytes
        a = b = width
        while True:
            a, b = min(a, len(left)), min(b, len(right))
            l, r = left[len(left) - a :], right[:b]
            w = self.whole(b"".join(map(size, l + r)))
            ok_l = a == len(left) or w[0] == l[0]
            ok_r = b == len(right) or w[-1] == r[-1]
            if ok_l and ok_r:
                return left[: len(left) - a] + w + right[b:]
            self.grown += 1
            a, b = (a if ok_l else a * 2), (b if ok_r else b * 2)


@lru_cache(maxsize=2)
def encoder(path: str | None = None, long_run: int = LONG_RUN) -> Encoder:
    """One per Python worker, which looks up the installed vocabulary itself where no path is given."""
    return Encoder(path or default_vocabulary(), long_run)


def encode(df: DataFrame, ident: str, text: str, path: str | None = None, count_only: bool = False, long_run: int = LONG_RUN, piece_chars: int = PIECE_CHARS) -> DataFrame:
    """ident and ids, or with ``count_only`` ident and n_tokens. Texts up to ``piece_chars`` need no shuffle; the others are spread over tasks.

    Counts are written to the shared folder together with the parts of long texts, from one scan. Ids are not: writing them once
    more costs more than a second look at the texts' lengths. The vocabulary is looked up where it is used.
    """
    src = spread(df.select(F.col(ident).alias("_id"), F.col(text).alias("_text")))
    kind = src.schema["_id"].dataType.simpleString()
    out = "n_tokens int" if count_only else "ids array<int>"

    def values(ids: list[list[int]]) -> pa.Array:
        return pa.array([len(x) for x in ids], pa.int32()) if count_only else pa.array(ids, pa.list_(pa.int32()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, long_run)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), values([enc.encode(t) for t in b.column(1).to_pylist()])], names=["_id", out.split()[0]])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Counts of short texts, parts of long ones."""
        enc = encoder(path, long_run)
        for b in batches:
            ids, no, rows = b.column(1), b.column(0), []
            for i, t in enumerate(b.column(2).to_pylist()):
                if t is None or len(t) <= piece_chars:
                    rows.append((i, len(enc.encode(t)), None, None, None, None))
                else:
                    rows += [(i, None, n, *x) for n, x in enumerate(cut_text(t, piece_chars, enc.cut))]
            at, *cols = zip(*rows) if rows else [()] * 6
            take = pa.array(at, pa.int64())
            types = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([no.take(take), ids.take(take), *(pa.array(c, t) for c, t in zip(cols, types))], names=["_no", "_id", "n_tokens", "part", "run", "raw", "ends"])

    if count_only:
        once = written(src.select(F.monotonically_increasing_id().alias("_no"), "_id", "_text").mapInArrow(count, f"_no bigint, _id {kind}, n_tokens int, {_PART}"), "tokens")
        short, parts = once.where("n_tokens IS NOT NULL").select("_id", "n_tokens"), once.where("part IS NOT NULL").drop("n_tokens")
    else:
        long = F.coalesce(F.length("_text"), F.lit(0)) > piece_chars
        short, parts = src.where(~long).mapInArrow(run, f"_id {kind}, {out}"), _cut(src.where(long), kind, path, long_run, piece_chars)
    return short.unionByName(_joined(parts, kind, path, long_run, count_only)).withColumnRenamed("_id", ident)


_PART = "part int, run int, raw binary, ends array<int>"


def cut_text(text: str, piece_chars: int, cut) -> Iterator[tuple[int, bytes, list[int] | None]]:  # noqa: ANN001
    """(run, bytes, ends) in order. A leaf of a long piece has the end 0 only, and leaves of one piece are one run; a part of other
    pieces has their ends in bytes, or null where it ends in no white space, so that it may be cut anew."""
    run, buf, chars = 0, [], 0

    def flush() -> tuple[int, bytes, list[int] | None]:
        ends = None if not buf[-1][-1:].isspace() else [*itertools.accumulate(len(x.encode()) for x in buf)]
        return run, "".join(buf).encode(), ends

    for m in cut.finditer(text):
        p = m.group()
        if len(p) > piece_chars // 2:
            if buf:
                yield flush()
                run, buf, chars = run + 1, [], 0
            raw, step = p.encode(), max(1, piece_chars // 2)
            for i in range(0, len(raw), step):
                yield run, raw[i : i + step], [0]
            run += 1
            continue
        buf.append(p)
        chars += len(p)
        if chars >= piece_chars and not p.isspace():
            yield flush()
            run, buf, chars = run + 1, [], 0
    if buf:
        yield flush()


def _cut(src: DataFrame, kind: str, path: str | None, long_run: int, piece_chars: int) -> DataFrame:
    """The parts of long texts."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, long_run)
        for b in batches:
            for i, t in enumerate(b.column(2).to_pylist()):
                rows = [(n, *x) for n, x in enumerate(cut_text(t, piece_chars, enc.cut))]
                cols = list(zip(*rows))
                head = [pa.array([b.column(c)[i].as_py()] * len(rows), b.column(c).type) for c in (0, 1)]
                types = (pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*head, *(pa.array(c, t) for c, t in zip(cols, types))], names=["_no", "_id", "part", "run", "raw", "ends"])

    return src.select(F.monotonically_increasing_id().alias("_no"), "_id", "_text").mapInArrow(cut, f"_no bigint, _id {kind}, {_PART}")


def encode_part(enc: Encoder, raw: bytes, ends: list[int] | None) -> list[int]:
    """The ids of a part, or of a leaf."""
    if ends is None:
        return enc.encode(raw.decode())
    if ends == [0]:
        return enc.tree(raw)
    out: list[int] = []
    for a, b in zip([0, *ends], ends):
        out += enc.piece(raw[a:b])
    return out


def join_parts(enc: Encoder, parts: list[tuple[int, list[int]]]) -> list[int]:
    """The ids of a text from (run, ids) of its parts in order: leaves of one run are joined as a tree, runs put together."""
    out: list[int] = []
    for _, g in itertools.groupby(parts, key=lambda x: x[0]):
        level = [x for _, x in g]
        while len(level) > 1:
            level = [enc.join(level[i], level[i + 1]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        out += level[0]
    return out


def _joined(parts: DataFrame, kind: str, path: str | None, long_run: int, count_only: bool) -> DataFrame:
    """Long texts from their parts: encoded in parallel, then joined, one text a group."""
    res = "n_tokens int" if count_only else "ids array<int>"

    def encode_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, long_run)
        for b in batches:
            ids = [encode_part(enc, r, e) for r, e in zip(b.column(4).to_pylist(), b.column(5).to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(ids, pa.list_(pa.int32()))], names=["_no", "_id", "part", "run", "ids"])

    def put(key, pdf):  # noqa: ANN001, ANN202
        import pandas as pd

        pdf = pdf.sort_values("part")
        out = join_parts(encoder(path, long_run), [(r, list(x)) for r, x in zip(pdf["run"], pdf["ids"])])
        return pd.DataFrame({"_id": [pdf["_id"].iloc[0]], res.split()[0]: [len(out) if count_only else out]})

    src = parts.select("_no", "_id", "part", "run", "raw", "ends").repartition(F.xxhash64("_no", "part"))
    done = src.mapInArrow(encode_parts, f"_no bigint, _id {kind}, part int, run int, ids array<int>")
    return done.groupBy("_no").applyInPandas(put, f"_id {kind}, {res}")


def held_against_whole(df: DataFrame, ident: str, text: str, path: str | None = None, long_run: int = LONG_RUN) -> DataFrame:
    """One row: documents, equal (the ids by trees are those of one encoding of the whole text), decoded (they decode to it), and joined (trees had joins). ``ident`` must be unique."""
    ids = encode(df, ident, text, path, long_run=long_run).select(F.col(ident).alias("_i"), "ids")
    src = df.select(F.col(ident).alias("_i"), F.col(text).alias("_t")).join(ids, "_i")
    names = ["documents", "equal", "decoded", "joins"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, long_run)
        for b in batches:
            n = [b.num_rows, 0, 0, 0]
            for t, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                before = enc.joins
                n[1] += x == (enc.enc.encode_ordinary(t) if t else [])
                n[2] += enc.enc.decode(x) == (t or "")
                enc.encode(t)
                n[3] += enc.joins - before
            yield pa.RecordBatch.from_arrays([pa.array([v], pa.int64()) for v in n], names=names)

    per = src.select("_t", "ids").mapInArrow(run, ", ".join(f"{c} bigint" for c in names))
    return per.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names)).select(*names[:3], (F.col("joins") > 0).alias("joined"))
