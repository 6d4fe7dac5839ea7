"""Overlaps of two tokenizers' tokens on the same bytes.

The texts of a batch lie one after the other on one line of bytes, and each
tokenizer cuts that line into tokens without a gap. ``pandas.merge_asof``, keyed
by document, finds for each token start the other side's covering token; two
tokens overlap just when one of them covers the other's start, so the union of
both directions holds every overlap. Where tokens of both sides end together a
group ends.

The corpus-wide count of an id pair is needed for every link of every document.
A row per link would be many times the texts, so the distinct pairs of a bundle
of documents are counted once and go out as one row each; the answers come back
by their place in the bundle's list.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reviewfold.llm.common import slices, split_sums, stored, texts_of
from reviewfold.llm.pieces import RankedEncoder, load_tokenizer, tokenizer_path

#: Text bytes aligned at once, and of the documents that share a list of pairs.
#: Aligning takes about 130 bytes of memory for each byte of text at its peak.
BATCH_BYTES, BUNDLE_BYTES = 512 << 10, 16 << 20
#: Links whose counts are added up at once.
SUM_LINKS = 1 << 20
#: Longer texts are encoded in parts of about so many characters, at blanks before a letter.
PART_CHARS = 1 << 19
_ID_BITS = 32
_CUT = re.compile("(?<=[A-Za-z]) (?=[A-Za-z])")

_BYTE_PIECE = re.compile("<0x([0-9A-F]{2})>")
_BLANK = "▁"
_MODELS: dict[tuple[str, ...], tuple] = {}


def _byte_level() -> dict[str, int]:
    """Byte of each character of a byte-level vocabulary: printable ones stand for
    themselves, the others for 256, 257 and so on, in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class ByteEncoder:
    """Ids and token bytes of a byte-level vocabulary; strings of special tokens are text."""

    def __init__(self, path: str, ranks: str):
        from public_tokenizers import PATTERN

        tokenizer = load_tokenizer(path)
        tokenizer.encode_special_tokens = True
        self.encoder = RankedEncoder(tokenizer, ranks, PATTERN)
        back = _byte_level()
        vocabulary = tokenizer.get_vocab(with_added_tokens=True)
        self.pieces = [b""] * (max(vocabulary.values()) + 1)
        for entry, number in vocabulary.items():
            known = all(c in back for c in entry)
            self.pieces[number] = bytes(back[c] for c in entry) if known else entry.encode()

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [self.encoder.encode(" " + text) for text in texts]


class PieceModel:
    """Ids and token bytes of a sentence-piece model, which adds the leading blank itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces = [self._bytes(self.model.id_to_piece(i)) for i in range(self.model.get_piece_size())]

    @staticmethod
    def _bytes(piece: str) -> bytes:
        found = _BYTE_PIECE.fullmatch(piece)
        return bytes([int(found[1], 16)]) if found else piece.replace(_BLANK, " ").encode()

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


def _models(paths: tuple[str, str, str]) -> tuple[ByteEncoder, PieceModel]:
    if paths not in _MODELS:
        _MODELS[paths] = ByteEncoder(*paths[:2]), PieceModel(paths[2])
    return _MODELS[paths]


class Side:
    """One tokenizer's tokens of the documents of a batch."""

    def __init__(self, ids: list[list[int]], sizes: np.ndarray):
        self.count = np.array([len(i) for i in ids], dtype=np.int64)
        self.ids = np.fromiter((t for i in ids for t in i), np.int64, int(self.count.sum()))
        self.doc = np.repeat(np.arange(len(ids)), self.count)
        length = sizes[self.ids] if len(self.ids) else np.zeros(0, np.int64)
        self.end = np.cumsum(length)
        self.start = self.end - length

    def frame(self, name: str) -> pd.DataFrame:
        return pd.DataFrame({"start": self.start, "doc": self.doc, name: np.arange(len(self.ids))})


def overlaps(a: Side, b: Side) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of every pair of an A and a B token whose byte ranges overlap."""
    left, right = a.frame("a"), b.frame("b")
    found = [pd.merge_asof(left, right, on="start", by="doc"), pd.merge_asof(right, left, on="start", by="doc")]
    # Tokens that start together are found from both sides.
    again = np.isin(b.start, a.start, assume_unique=True)
    links = pd.concat([found[0][["a", "b"]], found[1].loc[~again, ["a", "b"]]])
    return links["a"].to_numpy(np.int64), links["b"].to_numpy(np.int64)


class _Strings:
    """Group texts of whole batches: the decimal ids with the sign that follows each."""

    def __init__(self, n_a: int, n_b: int):
        written = [[b"%d%s" % (i, sign) for i in range(n)] for n, signs in ((n_a, b",|"), (n_b, b",;")) for sign in (signs[:1], signs[1:])]
        self.first = np.cumsum([0, n_a, n_a, n_b])
        self.table = np.array([x for part in written for x in part], dtype=object)

    def groups(self, a: Side, b: Side) -> tuple[np.ndarray, list[bytes]]:
        """Number of groups of each document, and their text."""
        last_a, last_b = np.isin(a.end, b.end, assume_unique=True), np.isin(b.end, a.end, assume_unique=True)
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        code = np.concatenate([a.ids + self.first[1] * last_a, b.ids + self.first[2] + (self.first[3] - self.first[2]) * last_b])
        order = np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")
        words = self.table[code[order]].tolist()
        each = a.count + b.count
        stops = np.cumsum(each)
        return split_sums(a.count, last_a.astype(np.int64)), [b"".join(words[s - n : s])[:-1] for s, n in zip(stops, each, strict=True)]


def _parts(text: str) -> Iterator[str]:
    """A text, or parts of a long one. Between two plain words neither tokenizer has a
    token that holds the blank and what stands before it; a part loses its leading
    blank, which the encoders add again."""
    start = 0
    while len(text) - start > PART_CHARS and (found := _CUT.search(text, start + PART_CHARS)):
        yield text[start : found.start()]
        start = found.end()
    if text:
        yield text[start:]


class _Lot:
    """Alignment of the documents of one batch, gathered over the parts of long texts."""

    def __init__(self, n: int):
        self.a, self.b, self.groups, self.links = (np.zeros(n, np.int64) for _ in range(4))
        self.broken = np.zeros(n, dtype=bool)
        self.text: list[list[bytes]] = [[] for _ in range(n)]
        self.pairs: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, owner: np.ndarray, texts: list[str], models: tuple[ByteEncoder, PieceModel], sizes, strings: _Strings) -> None:
        ids = [m.encode(texts) for m in models]
        for i, text in enumerate(texts):
            whole = (" " + text).encode()
            if any(b"".join([m.pieces[t] for t in found[i]]) != whole for m, found in zip(models, ids, strict=True)):
                self.broken[owner[i]] = True
                for found in ids:
                    found[i] = []
        a, b = (Side(found, s) for found, s in zip(ids, sizes, strict=True))
        at_a, at_b = overlaps(a, b)
        whose = owner[a.doc[at_a]]
        n_groups, written = strings.groups(a, b)
        for total, found in ((self.a, a.count), (self.b, b.count), (self.groups, n_groups)):
            np.add.at(total, owner, found)
        np.add.at(self.links, whose, 1)
        for i, text in zip(owner, written, strict=True):
            self.text[i].append(text)
        self.pairs.append((whose, a.ids[at_a] << _ID_BITS | b.ids[at_b]))

    def close(self) -> tuple[list[np.ndarray], list[str], np.ndarray]:
        """Counts, group texts and links of the documents in order; none of a broken one."""
        counts = [np.where(self.broken, 0, c) for c in (self.a, self.b, self.groups, self.links)]
        texts = ["" if bad else b";".join(t).decode() for t, bad in zip(self.text, self.broken, strict=True)]
        whose = np.concatenate([w for w, _ in self.pairs] or [np.zeros(0, np.int64)])
        pairs = np.concatenate([p for _, p in self.pairs] or [np.zeros(0, np.int64)])
        order = np.argsort(whose, kind="stable")
        return counts, texts, pairs[order][~self.broken[whose[order]]]


_COUNTS = ("n_a", "n_b", "n_groups", "n_links")


def _aligned(base: DataFrame, paths: tuple[str, str, str], with_groups: bool) -> DataFrame:
    """One row per document with its links as places in its bundle's list of id
    pairs, and one row per bundle (``pairs`` is not NULL) with that list."""
    kind = base.schema["doc"].dataType.simpleString()
    fields = {"bundle": "long", "doc": kind, **dict.fromkeys(_COUNTS, "long"), "groups": "string", "groups_sha256": "string"}
    fields |= {"links": "binary", "pairs": "array<long>", "times": "array<long>"}
    names, lists = list(fields), pa.list_(pa.int64())

    def numbered(docs: pa.Array, counts: list[np.ndarray], texts: list[str], links: np.ndarray) -> tuple:
        """A closed lot with its links as places in its own list of pairs."""
        digests = [hashlib.sha256(t.encode()).hexdigest() if t else "" for t in texts]
        pairs, where = np.unique(links, return_inverse=True)
        return docs, counts, texts if with_groups else None, digests, pairs, where.astype("<u4")

    def finish(bundle: int, held: list[tuple]) -> Iterator[pa.RecordBatch]:
        pairs = np.unique(np.concatenate([h[-2] for h in held]))
        times = np.zeros(len(pairs), np.int64)
        for docs, counts, texts, digests, own, where in held:
            place = np.searchsorted(pairs, own)
            times[place] += np.bincount(where, minlength=len(own))
            where = place.astype("<u4")[where]
            stops = np.cumsum(counts[-1])
            raw = [where[stop - n : stop].tobytes() for stop, n in zip(stops, counts[-1], strict=True)]
            shown = pa.nulls(len(docs), pa.string()) if texts is None else pa.array(texts)
            columns = [pa.array(np.full(len(docs), bundle)), docs, *map(pa.array, counts), shown, pa.array(digests, pa.string()), pa.array(raw, pa.binary())]
            yield pa.RecordBatch.from_arrays([*columns, *[pa.nulls(len(docs), lists)] * 2], names=names)
        none = [pa.nulls(1, c.type) for c in columns[1:]]
        yield pa.RecordBatch.from_arrays([pa.array([bundle]), *none, pa.array([pairs], lists), pa.array([times], lists)], names=names)

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = _models(paths)
        sizes = [np.array([len(p) for p in m.pieces], dtype=np.int64) for m in models]
        strings = _Strings(*[len(m.pieces) for m in models])
        bundle, held, size = TaskContext.get().partitionId() << 32, [], 0
        for whole in batches:
            for batch in slices(whole, 1, BATCH_BYTES):
                lot, owner, texts, chars = _Lot(batch.num_rows), [], [], 0
                for i, text in enumerate(batch.column(1).to_pylist()):
                    for part in _parts(text):
                        owner.append(i)
                        texts.append(part)
                        chars += len(part)
                        if chars >= BATCH_BYTES:
                            lot.add(np.array(owner), texts, models, sizes, strings)
                            owner, texts, chars = [], [], 0
                if texts:
                    lot.add(np.array(owner), texts, models, sizes, strings)
                held.append(numbered(batch.column(0), *lot.close()))
                size += batch.nbytes
                if size >= BUNDLE_BYTES:
                    yield from finish(bundle, held)
                    bundle, held, size = bundle + 1, [], 0
        if held:
            yield from finish(bundle, held)

    return base.mapInArrow(align, ", ".join(f"{n} {t}" for n, t in fields.items()))


def align_tokens(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    byte_model: tuple[str, str] | None = None,
    piece_model: str | None = None,
    with_groups: bool = False,
) -> DataFrame:
    """Per document the tokens of both sides, groups, links, and how common the links
    are: ``n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``, and with
    ``with_groups`` the groups themselves as ``a1,a2|b1;a3|b2,b3``.

    A is the byte-level vocabulary (its file and its rank file), B the
    sentence-piece model; both read the text with a blank before it. A link is a
    pair of an A and a B token whose bytes overlap; the count of its id pair is the
    number of links of all documents that hold it, and ``n_best`` counts the links
    whose count is the highest of their B id, ties included. NULL, an empty text and
    one that either side does not give back byte for byte have zeros and empty
    texts. Repeated rows are counted each on their own, other columns are ignored,
    an empty table gives no rows. A very long text is aligned in parts between words,
    where both sides end a token; its links make a bundle of their own.
    """
    byte_model = byte_model or (tokenizer_path("byte_bpe_50k.json"), tokenizer_path("byte_bpe_50k.tiktoken"))
    paths = (*byte_model, piece_model or tokenizer_path("piece_bpe_32k.model"))
    table = stored(_aligned(texts_of(docs, id_col, text_col), paths, with_groups), "aligned")
    listed = table.filter("pairs is not null").select("bundle", F.posexplode(F.arrays_zip("pairs", "times")).alias("place", "x"))
    pair = F.col("x.pairs").alias("pair")
    listed = listed.select("bundle", "place", pair, F.col("x.times").alias("times"))
    # A row per bundle and id pair; a window holds the bundles of one pair.
    everywhere = F.sum("times").over(Window.partitionBy("pair"))
    b_id = F.col("pair").bitwiseAND(F.lit((1 << _ID_BITS) - 1)).cast("int").alias("b")
    counted = stored(listed.select("bundle", "place", b_id, everywhere.alias("total")), "pair-counts")
    # A row per id of B's vocabulary at most.
    best = counted.groupBy("b").agg(F.max("total").alias("best"))
    answers = counted.join(F.broadcast(best), "b").select("bundle", "place", "total", (F.col("total") == F.col("best")).alias("best"))
    found = [c for c in ("doc", *_COUNTS, "groups", "groups_sha256", "links")]
    rows = table.filter("pairs is null").select("bundle", *found)

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        n = right.num_rows
        total, first = np.zeros(n, np.int64), np.zeros(n, np.int64)
        place = right.column("place").to_numpy()
        total[place], first[place] = right.column("total").to_numpy(), right.column("best").to_numpy()
        each, links = left.column("n_links").to_numpy(), left.column("links")
        stops, sums, row = np.cumsum(each), [], 0
        while row < left.num_rows:
            end = max(row + 1, int(np.searchsorted(stops, stops[row] - each[row] + SUM_LINKS, "right")))
            part = np.frombuffer(b"".join(links.slice(row, end - row).to_pylist()), "<u4")
            sums.append([split_sums(each[row:end], x[part]) for x in (first, total)])
            row = end
        n_best, count_sum = (np.concatenate([x[k] for x in sums] or [np.zeros(0, np.int64)]) for k in (0, 1))
        out = left.drop_columns(["bundle", "links"])
        return out.append_column("n_best", pa.array(n_best)).append_column("count_sum", pa.array(count_sum))

    kinds = {n: t for n, t in rows.dtypes if n not in ("bundle", "links")} | {"n_best": "long", "count_sum": "long"}
    schema = ", ".join(f"{n} {t}" for n, t in kinds.items())
    joined = rows.groupBy("bundle").cogroup(answers.groupBy("bundle")).applyInArrow(meet, schema)
    columns = [F.col("doc").alias(id_col), *_COUNTS, "n_best", "count_sum", "groups_sha256"]
    return joined.select(*columns, *(["groups"] if with_groups else []))
