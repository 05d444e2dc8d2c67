"""Encoding of a whole corpus with a public byte-level BPE tokenizer.

A byte-level BPE cuts a text into pieces first and never merges across them,
and no piece runs on from visible characters into white space.  So a text can
be cut into *words* (white space and the visible characters after it), each
distinct word encoded once, and the ids put back by position.

Spark splits the texts and counts their words, with a map-side combine and one
exchange of distinct words; the table is stored with the ids of each word.
Its head, the most frequent words up to a fixed bound, is sent to the
executors and put back where texts are read.  A text with words beyond the head
keeps its other ids between them, in parts; only those words and such texts
are joined by position.  Results don't depend on the bound.
"""

from __future__ import annotations

import base64
import os
import re
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrymill.session import stored

#: White space as Unicode's White_Space property has it.
_WS = r"\t-\r \x85\xa0  -     　"
WORD = rf"[{_WS}]*[^{_WS}]+|[{_WS}]+"
#: Most words of the head that is broadcast, and their most characters: at most about 8 MB.
HEAD_WORDS, HEAD_CHARS = 65_536, 64
#: Distinct words that a task counts at once.
FLUSH_WORDS = 400_000
VOCABULARY = "byte_bpe_50k.tiktoken"


def vocabulary_path(folder: str | None = None) -> str:
    """The rank file; ``folder`` is the tokenizers' folder on every executor."""
    return os.path.join(folder or os.environ.get("QUARRYMILL_TOKENIZERS", "/opt/tokenizers"), VOCABULARY)


def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _encoder(path: str):
    import tiktoken

    # pieces of a byte-level BPE: contractions, letters, digits, other signs, white space (fixed pattern of the public vocabulary)
    pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks(path), special_tokens={})


def _encoder(path: str):
    import tiktoken

    # pieces of a byte-level BPE: contractions, letters, digits, other signs, white space (fixed pattern of the public vocabulary)
    pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks(path), special_tokens={})


def _distinct(batches: Iterator) -> Iterator:
    import pyarrow as pa

    find, seen = re.compile(WORD).findall, Counter()

    def out():
        return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

    for b in batches:
        for text in b["text"].to_pylist():
            if text:
                seen.update(find(text))
        if len(seen) > FLUSH_WORDS:
            yield out()
            seen.clear()
    if seen:
        yield out()


def _distinct(batches: Iterator) -> Iterator:
    """Words and their number, combined within a task; a third of the cost of splitting in the JVM."""
    import pyarrow as pa

    find, seen = re.compile(WORD).findall, Counter()

    def out():
        return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

    for b in batches:
        for text in b["text"].to_pylist():
            if text:
                seen.update(find(text))
        if len(seen) > FLUSH_WORDS:
            yield out()
            seen.clear()
    if seen:
        yield out()


def _encode(path: str):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        encode = None
        for b in batches:
            encode = encode or _encoder(path).encode_ordinary
            yield pa.RecordBatch.from_arrays([b["word"], b["n"], pa.array([encode(w) for w in b["word"].to_pylist()], pa.list_(pa.int32()))], names=["word", "n", "ids"])

    return run


def word_table(documents: DataFrame, text_col: str = "text", folder: str | None = None) -> DataFrame:
    """(word, n, ids) of every distinct word: its occurrences and its ids.
    Null and empty texts have no words."""
    texts = documents.select(F.col(text_col).cast("string").alias("text")).where("text is not null and text <> ''")
    words = texts.mapInArrow(_distinct, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return words.mapInArrow(_encode(vocabulary_path(folder)), "word string, n bigint, ids array<int>")


def _place(head):
    """(doc_id, parts, words): the words of a text that are beyond the head, in
    order, and its other ids in parts: those before the first such word, an
    empty part in its place, those up to the next, and so on."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        known, lengths, ids = head.value
        find = re.compile(WORD).findall
        table = dict(zip(known, range(len(known)), strict=True))
        starts = np.r_[np.cumsum(lengths) - lengths, 0]  # the last place is for words beyond
        lengths = np.r_[lengths, 0]
        for whole in batches:
            for first in range(0, whole.num_rows, 1000):
                b = whole.slice(first, 1000)
                counts, where, beyond = np.zeros(b.num_rows, dtype="int64"), [], []
                for i, text in enumerate(b["text"].to_pylist()):
                    found = find(text) if text else ()
                    counts[i] = len(found)
                    w = np.fromiter([table.get(x, -1) for x in found], "int64", len(found))
                    where.append(w)
                    beyond.append([found[k] for k in np.flatnonzero(w < 0).tolist()])
                w = np.concatenate(where)
                n = lengths[w]
                ends = np.cumsum(n)
                flat = ids[np.repeat(starts[w] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]
                # ids stand one after the other; a part ends at each word beyond, twice, and at the end of its text
                places, last = np.flatnonzero(w < 0), np.cumsum(counts)
                edges = np.r_[np.repeat(np.r_[0, ends][places], 2), np.r_[0, ends][last]]
                order = np.argsort(np.r_[np.repeat(places, 2), last - 0.5], kind="stable")
                inner = pa.ListArray.from_arrays(pa.array(np.r_[0, edges[order]].astype("int32")), pa.array(flat, pa.int32()))
                sizes = 2 * np.array([len(x) for x in beyond], dtype="int64") + 1
                parts = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype("int32")), inner)
                yield pa.RecordBatch.from_arrays([b["doc_id"], parts, pa.array(beyond, pa.list_(pa.string()))], names=["doc_id", "parts", "words"])

    return run


def encode_corpus(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None, head_words: int = HEAD_WORDS) -> DataFrame:
    """(doc_id, ids): the ids of every row's text without special tokens.

    Defined cases: null and empty texts give an empty list; strings that look
    like special tokens are ordinary text; every input row gives one output
    row, repeated rows and null doc_ids included; an empty table gives none;
    further columns are ignored.
    """
    import numpy as np

    spark = documents.sparkSession
    table = stored(word_table(documents, text_col, folder), "words")
    short = table.where(F.length("word") <= HEAD_CHARS)
    # the least frequency that leaves at most ``head_words``, from at most 8 * 64 counts
    step = F.floor(F.log2("n") * 8)
    least, room = None, head_words
    for r in short.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect():
        room -= r["count"]
        if room < 0:
            break
        least = r["step"]
    frequent = short.where(F.lit(False) if least is None else step >= least).select("word", "ids").toArrow()
    lists = frequent["ids"].combine_chunks()
    lengths = np.asarray(lists.value_lengths().to_numpy(zero_copy_only=False), dtype="int64") if len(frequent) else np.zeros(0, "int64")
    head = spark.sparkContext.broadcast((frequent["word"].to_pylist(), lengths, np.asarray(lists.flatten().to_numpy(zero_copy_only=False), dtype="int32")))
    rows = documents.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    placed = rows.mapInArrow(_place(head), "doc_id bigint, parts array<array<int>>, words array<string>")
    placed = stored(placed.withColumn("row", F.monotonically_increasing_id()), "placed")
    done = placed.where(F.size("words") == 0).select("doc_id", F.col("parts")[0].alias("ids"))
    asked = placed.where(F.size("words") > 0).select("row", F.posexplode("words").alias("at", "word"))
    answers = asked.join(table.select("word", F.col("ids").alias("own")), "word").groupBy("row").agg(F.sort_array(F.collect_list(F.struct("at", "own"))).alias("own"))
    cut = placed.where(F.size("words") > 0).select("row", "doc_id", "parts").join(answers, "row")
    filled = F.flatten(F.transform("parts", lambda ids, i: F.when(i % 2 == 1, F.col("own")[(i / 2).cast("int")]["own"]).otherwise(ids)))
    return done.unionByName(cut.select("doc_id", filled.alias("ids")))


def decode_corpus(encoded: DataFrame, folder: str | None = None) -> DataFrame:
    """(doc_id, text) from (doc_id, ids), by a join of ids with the table of
    pieces (fixed at 50,256 rows): each id's bytes are looked up by position.
    An empty list gives an empty text; a null list or an unknown id gives null."""
    spark = encoded.sparkSession
    table = ranks(vocabulary_path(folder))
    pieces = spark.sparkContext.broadcast([p for p, _ in sorted(table.items(), key=lambda x: x[1])])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        get = pieces.value
        for b in batches:
            texts = [None if ids is None or any(not 0 <= i < len(get) for i in ids) else b"".join([get[i] for i in ids]).decode("utf-8", "replace") for ids in b["ids"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, text string")
