"""Language-model scores of documents from a sharded Elias-Fano n-gram trie.

Tokens are words (runs without ASCII white space, A-Z in lower case) and one end
token.  The model is a bigram model over the training documents:

    p1(w)   = (c(w) + 1) / (N + V + 1)
    p(w|v)  = (c(vw) + m(v) p1(w)) / (c(v) + m(v))

with m(v) the number of distinct successors for frequent contexts (those with at
least ``head_share`` of all tokens, so at most 1 / head_share of them, and the
start of a document) and ``weight`` for all others.  It sums to one over all
words, known or not.  A word's trie entry holds, for each context, the quantised
logarithm of c(vw) / (c(w) + 1), which is p(w|v) but for factors of w alone and
of v alone; c(w) is exact.

Jobs.  (1) Tasks count distinct bigrams of some two million tokens at a time and
send them, packed, to the shard of the second word; (2) a shard adds up and
writes its trie; (3) sums over shards give N, V, the frequent contexts and their
successors; (4) tasks send the bigrams of all documents, packed with document
numbers, to the same shards, which look them up and return packed partial sums;
(5) the partial sums of each chunk of documents are added.  Since the score is a sum of terms
that each need one shard, texts are never shuffled.  Shards that get far more
tokens than the mean are copied and share their requests.  All of the training
counts are kept: what is gathered grows with the corpus.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from .common import documents, materialize, slices
from .elias_fano import Trie

#: Characters of text for each shard of the model, about 1.3 million tokens; in large corpora up to so many times more,
#: as every chunk of text sends a row to every shard.
SHARD_CHARS, SHARD_GROWTH, SHARDS = 8_000_000, 16, 2048
#: Tokens that a task packs at once.
CHUNK_TOKENS = 2_000_000
#: Shards from which on the pieces of a shard are added up in two steps.
MERGE = 256
HEAD_SHARE, WEIGHT = 5e-4, 100.0
#: Shards that may be copied, at most.
HOT_SHARDS = 10_000
CACHE_WORDS = 500_000

_START, _END = np.uint64(0x5354415254), np.uint64(0x454E44)  # fixed values beside the hashes of words


class _Hashes(dict):
    """XXH64 of words, remembered."""

    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_known = _Hashes()


def token_hashes(text: str) -> np.ndarray:
    """64-bit hashes of a text's tokens, the end token last."""
    words = text.encode().lower().split()
    if len(_known) > CACHE_WORDS:
        _known.clear()
    out = np.empty(len(words) + 1, np.uint64)
    out[:-1] = np.fromiter(map(_known.__getitem__, words), np.uint64, len(words))
    out[-1] = _END
    return out


def context_of(h: np.ndarray) -> np.ndarray:
    """32 bits of a hash, as contexts are kept; the high ones choose the shard."""
    return (h & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def shard_of(h: np.ndarray, shards: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def _planes(x: np.ndarray) -> bytes:
    """The bytes of numbers, lowest bytes first, so that high zeros lie together."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.dtype.itemsize).T).tobytes()


def _unplanes(data, dtype: str) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).reshape(-1).view(dtype)


def _pieces(words: np.ndarray, order: np.ndarray, shards: int) -> Iterator[tuple[int, slice, np.ndarray, np.ndarray]]:
    """For sorted entries: (shard, their slice, the distinct words in a row, how often in a row) of each shard."""
    own = words[order]
    shard = shard_of(own, shards)
    cuts = np.flatnonzero(np.r_[True, np.diff(shard) != 0])
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(own)]):
        part = own[a:b]
        first = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        yield int(shard[a]), slice(a, b), part[first], np.diff(np.r_[first, b - a]).astype("<u4")


def _chunks(batches: Iterator[pa.RecordBatch], chunk: int, most: int) -> Iterator[tuple[list, np.ndarray, np.ndarray, np.ndarray]]:
    """(doc_ids, word hash, context, document number of each token) for about ``chunk`` tokens at a time."""
    docs, parts, size = [], [], 0

    def joined():
        words = np.concatenate(parts)
        length = np.array([len(p) for p in parts])
        before = np.r_[_START, words[:-1]]
        before[np.cumsum(length)[:-1]] = _START
        return docs, words, context_of(before), np.repeat(np.arange(len(parts), dtype="<u2"), length)

    for b in slices(batches):
        for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
            docs.append(doc)
            parts.append(token_hashes(text))
            size += len(parts[-1])
            if size >= chunk or len(parts) >= most:
                yield joined()
                docs, parts, size = [], [], 0
    if parts:
        yield joined()


_COUNTED = "shard long, part long, words binary, runs binary, contexts binary, counts binary"


def _counted_row(shard: int, words, runs, contexts, counts) -> tuple:
    return shard, 0, words.tobytes(), _planes(runs), contexts.tobytes(), _planes(counts.astype("<u8"))


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    """One batch of rows of longs and byte strings."""
    names, kinds = zip(*(f.split(" ") for f in schema.split(", ")))
    columns = zip(*rows) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k == "long" else pa.binary()) for c, k in zip(columns, kinds)], list(names))


def _count(shards: int, chunk: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, words, contexts, _docs in _chunks(batches, chunk, 65_535):
            order = np.argsort((words & np.uint64(0xFFFFFFFF00000000)) | contexts.astype(np.uint64))
            w, c = words[order], contexts[order]
            first = np.flatnonzero(np.r_[True, (w[1:] != w[:-1]) | (c[1:] != c[:-1])])
            times = np.diff(np.r_[first, len(w)])
            w, c = w[first], c[first]
            yield _batch([_counted_row(shard, distinct, runs, c[at], times[at]) for shard, at, distinct, runs in _pieces(w, np.arange(len(w)), shards)], _COUNTED)

    return run


def _added(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, context, count) of all rows of a shard, distinct and sorted."""
    words, contexts, counts = [], [], []
    for w, r, c, n in zip(*(table.column(k) for k in ("words", "runs", "contexts", "counts"))):
        words.append(np.repeat(np.frombuffer(w.as_buffer(), "<u8"), _unplanes(r.as_buffer(), "<u4")))
        contexts.append(np.frombuffer(c.as_buffer(), "<u4"))
        counts.append(_unplanes(n.as_buffer(), "<u8"))
    w, c, n = np.concatenate(words), np.concatenate(contexts), np.concatenate(counts).astype(np.int64)
    order = np.lexsort((c, w))
    w, c, n = w[order], c[order], n[order]
    first = np.flatnonzero(np.r_[True, (w[1:] != w[:-1]) | (c[1:] != c[:-1])])
    return w[first], c[first], np.add.reduceat(n, first)


def _merge(table: pa.Table) -> pa.Table:
    w, c, n = _added(table)
    first = np.flatnonzero(np.r_[True, w[1:] != w[:-1]])
    return pa.Table.from_batches([_batch([_counted_row(table.column("shard")[0].as_py(), w[first], np.diff(np.r_[first, len(w)]).astype("<u4"), c, n)], _COUNTED)])


_MODEL = "shard long, tokens long, words long, head_words binary, head_counts binary, trie binary"


def _build(head_share: float):
    def run(table: pa.Table) -> pa.Table:
        w, c, n = _added(table)
        first = np.flatnonzero(np.r_[True, w[1:] != w[:-1]])
        total = np.add.reduceat(n, first)
        starts = np.r_[first, len(w)]
        values = np.log10(n) - np.log10(np.repeat(total, np.diff(starts)) + 1)
        head = np.flatnonzero(total >= head_share * total.sum())  # no frequent word is missing: N is at least the shard's tokens
        trie = Trie.build(w[first], total, starts, c, values)
        return pa.table({
            "shard": table.column("shard").slice(0, 1), "tokens": pa.array([int(total.sum())]), "words": pa.array([len(first)]),
            "head_words": pa.array([w[first][head].tobytes()], pa.binary()), "head_counts": pa.array([total[head].astype("<i8").tobytes()], pa.binary()), "trie": pa.array([trie], pa.binary()),
        })

    return run


def _frequent(least: float):
    """The words of each shard that are frequent among all: at most 1 / head_share in all shards together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for words, counts in zip(b.column("head_words"), b.column("head_counts")):
                w, n = np.frombuffer(words.as_buffer(), "<u8"), np.frombuffer(counts.as_buffer(), "<i8")
                yield pa.RecordBatch.from_arrays([pa.array(w[n >= least].view(np.int64)), pa.array(n[n >= least].astype(np.int64))], ["word", "n"])

    return run


def _successors(contexts: np.ndarray):
    """For each shard, in how many of its words each of the given (ascending) contexts was seen."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for blob in b.column("trie"):
                trie = Trie(blob.as_buffer())
                seen = context_of(trie.level2.at(np.arange(trie.grams)))
                at = np.searchsorted(contexts, seen).clip(0, len(contexts) - 1)
                found = np.bincount(at[contexts[at] == seen], minlength=len(contexts))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(contexts))), pa.array(found.astype(np.int64))], ["k", "n"])

    return run


class Statistics:
    """What every task knows: N, V, and for the frequent contexts (bounded) their counts and weights."""

    def __init__(self, tokens: int, words: int, contexts: np.ndarray, counts: np.ndarray, weights: np.ndarray, weight: float):
        self.tokens, self.words, self.weight = tokens, words, weight
        self.contexts, self.counts, self.weights = contexts, counts, weights

    def smoothing(self, context: np.ndarray) -> np.ndarray:
        if not len(self.contexts):
            return np.full(len(context), self.weight)
        at = np.searchsorted(self.contexts, context).clip(0, len(self.contexts) - 1)
        return np.where(self.contexts[at] == context, self.weights[at], self.weight)


def train(docs: DataFrame, shards: int, head_share: float = HEAD_SHARE, weight: float = WEIGHT, chunk: int = CHUNK_TOKENS) -> tuple[DataFrame, Statistics]:
    """(model, statistics) from (doc_id, text); the model is a table in the shared folder, a row for each shard."""
    pieces = docs.mapInArrow(_count(shards, chunk), _COUNTED)
    if shards > MERGE:  # a chunk is more text than a shard's share, so there are fewer pieces than shards
        pieces = pieces.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(64)).cast("long")).groupBy("shard", "part").applyInArrow(_merge, _COUNTED)
    model = materialize(pieces.groupBy("shard").applyInArrow(_build(head_share), _MODEL), "ngram-trie")
    n_docs = docs.count()
    tokens, words = model.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first()
    rows = model.select("head_words", "head_counts").mapInArrow(_frequent(head_share * tokens), "word long, n long").collect()
    found = np.array([(r["word"], r["n"]) for r in rows], np.int64).reshape(-1, 2).T.view(np.uint64)
    found = found[:, found[0] != _END]
    contexts = np.r_[context_of(found[0]), context_of(np.array([_START]))]
    counts = np.r_[found[1].astype(np.int64), n_docs]
    contexts, at = np.unique(contexts, return_index=True)
    successors = model.select("trie").mapInArrow(_successors(contexts), "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect()
    weights = np.full(len(contexts), 1.0)
    for r in successors:
        weights[r["k"]] = max(1.0, r["n"])
    return model, Statistics(tokens, words, contexts, counts[at], weights, weight)


_REQUEST = "chunk long, shard long, copy long, places binary, docs binary, words binary, runs binary, contexts binary, numbers binary"


def _ask(shards: int, copies: dict[int, int], chunk: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for ids, words, contexts, docs in _chunks(batches, chunk, 65_535):
            order = np.argsort((words & np.uint64(0xFFFFFFFF00000000)) | contexts.astype(np.uint64))
            c, d = contexts[order], docs[order]
            names = np.array([(-1 << 63) if i is None else i for i in ids], "<i8")
            rows = []
            for shard, at, distinct, runs in _pieces(words, order, shards):
                present, numbers = np.unique(d[at], return_inverse=True)
                blobs = (present.astype("<u2").tobytes(), names[present].tobytes(), distinct.tobytes(), _planes(runs), c[at].tobytes(), _planes(numbers.astype("<u2")))
                rows.append((number, shard, number % copies.get(shard, 1), *blobs))
            yield _batch(rows, _REQUEST)
            number += 1

    return run


#: Sums of one shard for the documents of one chunk, packed; a document is told by its place in the chunk, so rows that share a doc_id stay apart.
_PARTIAL = "chunk long, sums binary"
_SUMS = np.dtype([("place", "<u2"), ("doc_id", "<i8"), ("n_tokens", "<u4"), ("n_known", "<u4"), ("base", "<f8"), ("score", "<f8")])
_SCORED = "doc_id long, n_tokens long, n_known long, base_score double, score double"


def _answer(stats: Statistics) -> Callable[[pa.Table, pa.Table], pa.Table]:
    z = stats.tokens + stats.words + 1
    start = np.flatnonzero(stats.contexts == context_of(np.array([_START]))[0])
    begin = float(np.log10(stats.counts[start[0]] + stats.weights[start[0]])) if len(start) else 0.0

    def run(requests: pa.Table, model: pa.Table) -> pa.Table:
        trie = Trie(model.column("trie")[0].as_buffer()) if model.num_rows else None
        out = []
        for places, docs, w, r, c, k in zip(*(requests.column(x) for x in ("places", "docs", "words", "runs", "contexts", "numbers"))):
            words, runs = np.frombuffer(w.as_buffer(), "<u8"), _unplanes(r.as_buffer(), "<u4")
            contexts, numbers = np.frombuffer(c.as_buffer(), "<u4"), _unplanes(k.as_buffer(), "<u2").astype(np.int64)
            ids = np.frombuffer(docs.as_buffer(), "<i8")
            rank = trie.rank(words) if trie else np.full(len(words), -1)
            count = np.where(rank >= 0, trie.counts[rank.clip(0)], 0) if trie else np.zeros(len(words), np.int64)
            # a word's own terms: as a token, and as the context of the next; for each end there is one start of a document
            held = np.where(words == _END, -begin, -np.log10(count + stats.smoothing(context_of(words))))
            p1 = (count + 1) / z
            each = np.repeat(np.arange(len(words)), runs)
            ratio = trie.value(rank[each], contexts) if trie else np.full(len(each), np.nan)
            joint = np.where(np.isnan(ratio), 0.0, 10.0 ** np.nan_to_num(ratio) * z)  # c(vw) / p1(w)
            score = np.log10(p1[each] * (joint + stats.smoothing(contexts))) + held[each]
            n = len(ids)
            sums = np.zeros(n, _SUMS)
            sums["place"] = np.frombuffer(places.as_buffer(), "<u2")
            sums["doc_id"], sums["n_tokens"], sums["n_known"] = ids, np.bincount(numbers, minlength=n), np.bincount(numbers, (count > 0)[each], n)
            sums["base"], sums["score"] = np.bincount(numbers, np.log10(p1)[each], n), np.bincount(numbers, score, n)
            out.append(sums.tobytes())
        return pa.table({"chunk": requests.column("chunk"), "sums": pa.array(out, pa.binary())})

    return run


def _total(parts: pa.Table) -> pa.Table:
    """The sums of a chunk's documents over all shards."""
    rows = np.concatenate([np.frombuffer(x.as_buffer(), _SUMS) for x in parts.column("sums")])
    _, first, at = np.unique(rows["place"], return_index=True, return_inverse=True)
    ids = rows["doc_id"][first]
    total = {k: np.bincount(at, rows[k], len(ids)) for k in ("n_tokens", "n_known", "base", "score")}
    return pa.table({"doc_id": pa.array(ids, pa.int64(), mask=ids == -1 << 63), **{("base_score" if k == "base" else k): pa.array(v.astype(np.int64) if k[0] == "n" else v) for k, v in total.items()}})


def score(docs: DataFrame, model: DataFrame, stats: Statistics, shards: int, chunk: int = CHUNK_TOKENS) -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score) of each row of (doc_id, text)."""
    mean = max(1, stats.tokens // shards)
    hot = model.filter(F.col("tokens") > 4 * mean).select("shard", "tokens").orderBy(F.desc("tokens")).limit(HOT_SHARDS).collect()
    copies = {r["shard"]: -(-r["tokens"] // (2 * mean)) for r in hot}
    times = F.lit(1).cast("long")
    if copies:
        table = docs.sparkSession.createDataFrame(list(copies.items()), "shard long, times long")
        copied = model.select("shard", "trie").join(F.broadcast(table), "shard", "left")  # at most HOT_SHARDS rows
        times = F.coalesce("times", F.lit(1).cast("long"))
    else:
        copied = model.select("shard", "trie")
    copied = copied.select("shard", F.explode(F.sequence(F.lit(0).cast("long"), times - 1)).alias("copy"), "trie")
    asked = docs.mapInArrow(_ask(shards, copies, chunk), _REQUEST)
    parts = asked.groupBy("shard", "copy").cogroup(copied.groupBy("shard", "copy")).applyInArrow(_answer(stats), _PARTIAL)
    return parts.groupBy("chunk").applyInArrow(_total, _SCORED)


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_out: Column | None = None, shard_chars: int = SHARD_CHARS, **training) -> DataFrame:
    """One row for each document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    The model learns from documents that are not held out (default: crc32 of
    doc_id as text, mod 7, is 2) and scores all.  Null and empty texts are the
    end token; rows that share a doc_id are scored each; an empty input gives an empty result, and without training documents all
    words are unknown; other columns are ignored.  The rows of a task must be the
    same when it runs again, as they are when ``docs`` reads files: write the
    result of a shuffle first.
    """
    rows = documents(docs, id_col, text_col)
    held = held_out if held_out is not None else F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    held = F.coalesce(held, F.lit(False))
    chars = rows.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    shards = max(1, -(-chars // (shard_chars * SHARD_GROWTH)), min(-(-chars // shard_chars), SHARDS))
    model, stats = train(rows.filter(~held), shards, **training)
    scored = score(rows, model, stats, shards, training.get("chunk", CHUNK_TOKENS))
    return scored.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(stats.tokens).cast("long").alias("train_tokens"), "base_score", "score")
