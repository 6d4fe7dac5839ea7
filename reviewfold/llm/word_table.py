"""BPE encoding and decoding through a table of distinct words.

Texts are split into words in Spark, each distinct word of the corpus is
encoded once, in the group its hash names, and its ids return to the texts by
position. Decoding joins the ids with the pieces of the vocabulary.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from reviewfold.llm.bundles import Words, answer_words, combined_words, text_bundles, with_answers, word_requests
from reviewfold.llm.pieces import gather, load_tokenizer, tokenizer_path

# Never a word, so that a bundle of empty texts has an answer too.
_NOTHING = b"\n"
_LOADED: dict[str, object] = {}


def _tokenizer(path: str):
    if path not in _LOADED:
        _LOADED[path] = load_tokenizer(path)
    return _LOADED[path]


def _pieces(path: str) -> pa.Array:
    """The piece of every id: one row per entry of the vocabulary."""
    key = f"{path} pieces"
    if key not in _LOADED:
        tokenizer = _tokenizer(path)
        size = tokenizer.get_vocab_size(with_added_tokens=True)
        _LOADED[key] = pa.array([tokenizer.id_to_token(i) or "" for i in range(size)], pa.string())
    return _LOADED[key]


def _words(tables: list[pa.Table]) -> Words:
    # bytes.split cuts at U+0020 and U+0009 to U+000D only.
    return Words(tokens for t in tables for tokens in [*(text.split() for text in t.column("body").to_pylist()), [_NOTHING]])


def encode_round_trip(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: str | None = None,
    outputs: bool = False,
) -> DataFrame:
    """Id, ``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` for every row;
    with ``outputs`` also ``ids`` and ``decoded`` themselves.

    The vocabulary must drop white space and have no decoder, as
    ``word_bpe_49k.json``: decoded pieces are then joined by one space. A NULL
    or empty text has no tokens. Repeated rows give repeated results; an empty
    table gives no rows.
    """
    path = vocabulary or tokenizer_path("word_bpe_49k.json")
    bundles, n = text_bundles(docs, id_col, text_col)

    def encode(asked: list[pa.Table]) -> list[pa.Table]:
        words, codes = combined_words(asked)
        tokenizer, counts, parts = _tokenizer(path), [], []
        for at in range(0, len(words), 4096):
            plain = [w.decode("utf-8", "replace") for w in words[at : at + 4096]]
            ids = [e.ids for e in tokenizer.encode_batch_fast(plain, add_special_tokens=False)]
            counts.extend(map(len, ids))
            parts.append(np.array([i for each in ids for i in each], dtype=np.int32))
        count = np.array(counts, dtype=np.int64)
        table = pa.array(np.concatenate(parts))
        offsets = pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32))
        all_ids = pa.ListArray.from_arrays(offsets, table)
        return [pa.table({"ids": all_ids.take(pa.array(c))}) for c in codes]

    def finish(tables: list[pa.Table], words: Words, facts: pa.Table) -> pa.Table:
        ids = facts.column("ids").combine_chunks()
        flat = ids.flatten().to_numpy().astype(np.uint32)
        count = pc.list_value_length(ids).to_numpy().astype(np.int64)
        start = np.cumsum(count) - count
        pieces = _pieces(path)
        out: dict[str, list] = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": [], "ids": [], "decoded": []}
        stops = np.cumsum(words.sizes)
        doc, at = [], 0
        for table in tables:
            doc.append(table.column("doc"))
            for _ in range(table.num_rows):
                mine = gather(words.codes[stops[at] - words.sizes[at] : stops[at]], count, start, flat)
                spelled = pa.ListArray.from_arrays(pa.array([0, len(mine)], pa.int32()), pieces.take(pa.array(mine)))
                decoded = pc.binary_join(spelled, " ")[0].as_py()
                out["n_tokens"].append(len(mine))
                out["ids_sha256"].append(hashlib.sha256(mine.astype("<u4").tobytes()).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(decoded.encode("utf-8")).hexdigest())
                if outputs:
                    out["ids"].append(mine)
                    out["decoded"].append(decoded)
                at += 1
            at += 1  # the entry that is no text
        columns = {"doc": pa.chunked_array([c for d in doc for c in d.chunks], type=tables[0].schema.field("doc").type)}
        columns |= {"n_tokens": pa.array(out["n_tokens"], pa.int64())}
        columns |= {k: pa.array(out[k], pa.string()) for k in ("ids_sha256", "decoded_sha256")}
        if outputs:
            columns |= {"ids": pa.array([i.tolist() for i in out["ids"]], pa.list_(pa.int64()))}
            columns |= {"decoded": pa.array(out["decoded"], pa.string())}
        return pa.table(columns)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    schema += ", ids array<long>, decoded string" if outputs else ""
    answers = answer_words(word_requests(bundles, n, _words), encode)
    return with_answers(bundles, answers, n, _words, finish, schema).withColumnRenamed("doc", id_col)
