"""Collocations: phrases of 2 to 4 words that hold together, mined for each language.

Candidates grow by the Apriori rule: a phrase can only occur ``least`` times if
all the shorter phrases in it do.

1. Scans.  One scan counts the 64-bit hashes of words, the next those of word
   pairs whose words passed, the third those of three and four words whose pairs
   passed.  Tasks count before the shuffle.  Hashes with ``least`` counts or more
   are the candidates; they are written, and marked in one bitmap of BITS bits,
   the only thing that is broadcast; its size is fixed.  Two phrases on one bit
   only let more candidates through.
2. Slots.  Candidates are dealt into shards by hash; in a shard, a minimal perfect
   hash gives each a slot, which holds its key.
3. Counts.  A last scan keeps the phrases all of whose parts are marked, and sends
   each shard one block of keys, counts and words for each task.  Mappers look up
   the blocks' slots, verify the stored keys, and bincount into an array of the
   shard's slots; the arrays are summed as a tree of FAN_IN.  A second hash of 32
   bits tells phrases of one key apart: those that don't get the slot are counted aside.
4. Cuts.  Each candidate asks the shards of both parts of each of its cuts, which
   read the counts by slot.  Shards that many ask are copied for more tasks.

No count is approximate, and no phrase with ``least`` occurrences is lost.  Two
phrases are the same if their hashes of 96 bits are.

Defined results: null texts are empty, null languages are ``und``; rows repeat as
often as they stand there; phrases don't reach over separators; equal scores are
ordered by count, then by the phrase's UTF-8 bytes; an empty table gives an empty
result; other columns, doc_id included, are ignored.  Long texts are read in
parts of some CHUNK bytes, cut at separators.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import materialize, slices, text_of
from .exact_dedup import build_perfect_hash, find_slots

LONGEST, LEAST, TOP, CONTAINED = 4, 30, 2000, 80
#: Bits of the marks: 16 MB.
BITS = 1 << 27
#: Candidates in a shard, keys that a mapper or reader gets, about; arrays that are summed at once.
SHARD, ROWS, FAN_IN = 1 << 15, 1 << 18, 16
#: Bits of a key; fewer only in tests, where phrases then share keys.
WIDTH = 64
#: Bytes of text that a task cuts into words at once; hashes that it holds before it sends them on.
CHUNK, HELD = 4 << 20, 1 << 20
#: Words of a language that a task remembers, about.
WORDS = 1 << 18

_SECOND = (1 << 32) - 1
_BOUNDARY = b"."  # a separator, so no word
_TABLE = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz " + b"." * 9)


def _parts(text: bytes, chunk: int) -> Iterator[bytes]:
    while len(text) > chunk:
        at = text.rfind(_BOUNDARY, 0, chunk)
        at = at if at >= 0 else text.find(_BOUNDARY, chunk)
        if at < 0:
            break
        yield text[:at]
        text = text[at + 1 :]
    yield text


class Vocabulary:
    """Numbers of a language's words in the order they come, 0 for a boundary, and what is computed of each word once."""

    def __init__(self, lang: str, width: int):
        self.number: defaultdict = defaultdict()
        self.number.default_factory = self.number.__len__
        self.number[_BOUNDARY]
        self.words: list[bytes] = []
        seeds = [xxhash.xxh64_intdigest(lang.encode(), lane) for lane in (0, 1)]
        self.of = [lambda w: xxhash.xxh64_intdigest(w, seeds[0]) & ((1 << width) - 1), lambda w: xxhash.xxh64_intdigest(w, seeds[1]), len]
        self.known = [np.zeros(0, np.uint64) for _ in self.of]

    def numbers(self, tokens: list[bytes]) -> np.ndarray:
        ids = np.fromiter(map(self.number.__getitem__, tokens), np.int64, len(tokens))
        self.words.extend(islice(self.number, len(self.words), None))
        return ids

    def values(self, which: int) -> np.ndarray:
        """Of each word its key (0), its second hash (1) or its length in bytes (2)."""
        known = self.known[which]
        if len(known) < len(self.words):
            known = self.known[which] = np.concatenate([known, np.array(list(map(self.of[which], self.words[len(known) :])), np.uint64)])
        return known


def _read(batches, chunk: int, width: int) -> Iterator[tuple[str, Vocabulary, np.ndarray, bytes]]:
    """(language, its vocabulary, numbers of the words in order, the words in order with a space between)."""
    held, size, known = defaultdict(list), 0, {}

    def numbered():
        for lang, texts in held.items():
            vocabulary = known.get(lang)
            if vocabulary is None or len(vocabulary.words) > WORDS:
                vocabulary = known[lang] = Vocabulary(lang, width)
            tokens = b" . ".join(texts).replace(b".", b" . ").split()
            ids, line = vocabulary.numbers(tokens), b" ".join(tokens)
            del tokens
            yield lang, vocabulary, ids, line
        held.clear()
        if sum(len(v.words) for v in known.values()) > 2 * WORDS:
            known.clear()

    for batch in slices(batches):
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for part in _parts(text.translate(_TABLE), chunk):
                held[lang].append(part)
                size += len(part) + 64
                if size >= chunk:
                    yield from numbered()
                    size = 0
    yield from numbered()


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (a * np.uint64(0x9E3779B97F4A7C15)) ^ (b + np.uint64(0x632BE59BD9B4E019))
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(29))


def _marked(marks: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes & np.uint64(8 * len(marks) - 1)
    return (marks[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _hashes(of_word: np.ndarray, ids: np.ndarray, marks: np.ndarray | None, known: int, longest: int, width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(n, starts, keys) for the phrases of n words, n up to ``longest``, whose parts of up to ``known`` words are all marked."""
    starts = np.flatnonzero(ids != 0)
    h = of_word[ids[starts]]
    yield 1, starts, h
    word_ok = _marked(marks, of_word) if known else None
    for n in range(2, longest + 1):
        ok = np.zeros(len(ids) + 1, bool)
        ok[starts] = n - 1 > known or (word_ok[ids[starts]] if n == 2 else _marked(marks, h))
        both = ok[starts] & ok[starts + 1]
        starts = starts[both]
        h = _mixed(h[both], of_word[ids[starts + n - 1]]) & np.uint64((1 << width) - 1)
        yield n, starts, h


def _counted(hashes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    h, n = np.concatenate(hashes), np.concatenate(counts)
    order = np.argsort(h, kind="stable")
    h, n = h[order], n[order]
    first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, np.int64)
    return h[first], np.add.reduceat(n, first) if len(h) else n


def _hash_counts(lengths: tuple[int, ...], marks, chunk: int, held_at_most: int, width: int):
    """Counts of the keys of phrases of these lengths; with words, also of all words of each language."""

    def of(batches):
        own = np.frombuffer(marks.value, np.uint8) if marks is not None else None
        hashes, counts, held, totals = [], [], 0, defaultdict(int)

        def rows(h, n):
            for at in range(0, len(h), 1 << 16):
                part = slice(at, at + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.nulls(len(h[part]), pa.string()), pa.array(h[part].view(np.int64)), pa.array(n[part])], ["lang", "h", "n"])

        for lang, words, ids, _ in _read(batches, chunk, width):
            totals[lang] += int((ids != 0).sum())
            for n, _, h in _hashes(words.values(0), ids, own, min(lengths) - 1, max(lengths), width):
                if n in lengths:
                    values, times = np.unique(h, return_counts=True)
                    hashes.append(values), counts.append(times.astype(np.int64))
                    held += len(values)
            if held > held_at_most:
                h, n = _counted(hashes, counts)
                hashes, counts, held = [h], [n], len(h)
                if held > held_at_most // 2:
                    yield from rows(h, n)
                    hashes, counts, held = [], [], 0
        if hashes:
            yield from rows(*_counted(hashes, counts))
        if 1 in lengths and totals:
            yield pa.RecordBatch.from_arrays([pa.array(totals.keys(), pa.string()), pa.nulls(len(totals), pa.int64()), pa.array(totals.values(), pa.int64())], ["lang", "h", "n"])

    return of


def _bitmap(table: pa.Table) -> pa.Table:
    block = table.column("block")[0].as_py()
    bits = np.zeros(1 << 18, np.uint8)
    bits[table.column("at").to_numpy()] = 1
    return pa.table({"block": pa.array([block], pa.int64()), "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})


def _mark(texts: DataFrame, lengths: tuple[int, ...], marks: bytearray, least: int, chunk: int, held: int, width: int) -> DataFrame:
    """(lang, h, n): the keys of phrases of these lengths that occur often enough, all of whose parts are marked; marked now, too.

    Rows with lang count all words of a language.
    """
    known = texts.sparkSession.sparkContext.broadcast(bytes(marks)) if min(lengths) > 1 else None
    counts = texts.mapInArrow(_hash_counts(lengths, known, chunk, held, width), "lang string, h long, n long").groupBy("lang", "h").agg(F.sum("n").alias("n"))
    heavy = materialize(counts.filter((F.col("n") >= least) | F.col("lang").isNotNull()), "often")
    bit = heavy.filter("lang IS NULL").select(F.col("h").bitwiseAND(F.lit(8 * len(marks) - 1)).alias("bit")).distinct()
    blocks = bit.select(F.shiftright("bit", 18).alias("block"), F.col("bit").bitwiseAND(F.lit((1 << 18) - 1)).alias("at")).groupBy("block").applyInArrow(_bitmap, "block long, bits binary")
    all_marks = np.frombuffer(marks, np.uint8)
    for r in blocks.toLocalIterator():  # len(marks) bytes in all
        at = r["block"] << 15
        own = np.frombuffer(r["bits"], np.uint8)[: len(marks) - at]
        all_marks[at : at + len(own)] |= own
    return heavy


_BLOCK = "shard int, part int, lang string, h binary, g binary, n binary, sizes binary, text binary"


def _packed(x: np.ndarray) -> bytes:
    """Numbers from 0 on in as many bytes as the greatest needs."""
    return x.astype(np.min_scalar_type(int(x.max(initial=0)))).tobytes()


def _unpacked(data: bytes, count: int) -> np.ndarray:
    return np.frombuffer(data, f"<u{len(data) // count}").astype(np.int64) if count else np.zeros(0, np.int64)


def _blocks(marks, shards: int, parts: int, longest: int, chunk: int, held_at_most: int, width: int):
    """The phrases of marked parts of a task: for each shard and language a block of keys, second hashes, counts and words."""

    def of(batches):
        own, held, size = np.frombuffer(marks.value, np.uint8), defaultdict(list), 0
        for lang, words, ids, line in _read(batches, chunk, width):
            h_word, g_word, length = words.values(0), words.values(1), words.values(2).astype(np.int64)[ids] + 1
            begin = np.cumsum(length) - length
            codes = ids  # a number for each phrase of n - 1 words, by start
            for n, starts, h in _hashes(h_word, ids, own, longest, longest, width):
                passed = _marked(own, h)
                starts, h = starts[passed], h[passed]
                first, dense, times = _numbered(ids[starts], len(h_word)) if n == 1 else _distinct(codes[starts] * len(h_word) + ids[starts + n - 1])
                codes = np.zeros(len(ids), np.int64)
                codes[starts] = dense
                at = starts[first]
                g = g_word[ids[at]]
                for k in range(1, n):
                    g = _mixed(g, g_word[ids[at + k]])
                g &= np.uint64(_SECOND)
                held[lang].append((h[first], g, times, line, begin[at], begin[at + n - 1] + length[at + n - 1] - 1))
                size += len(first)
            if size > held_at_most:
                yield from sent(held)
                held, size = defaultdict(list), 0
        yield from sent(held)

    def sent(held):
        part = (TaskContext.get().partitionId() if TaskContext.get() else 0) % parts
        for lang, known in held.items():
            h, g, n, begin, end = (np.concatenate([x[c] for x in known]) for c in (0, 1, 2, 4, 5))
            source = np.repeat(np.arange(len(known)), [len(x[0]) for x in known])
            shard = (h % np.uint64(shards)).astype(np.int64)
            order = np.lexsort((g, h, shard))
            first = np.flatnonzero(np.r_[True, (h[order][1:] != h[order][:-1]) | (g[order][1:] != g[order][:-1])]) if len(order) else order
            n = np.add.reduceat(n[order], first) if len(order) else n
            order = order[first]
            cuts = np.searchsorted(shard[order], np.arange(shards + 1))
            for s in range(shards):
                i = order[cuts[s] : cuts[s + 1]]
                if len(i):
                    texts = [known[k][3][a:b] for k, a, b in zip(source[i].tolist(), begin[i].tolist(), end[i].tolist())]
                    row = {"shard": s, "part": part, "lang": lang, "h": h[i].tobytes(), "g": g[i].astype(np.uint32).tobytes(), "n": _packed(n[cuts[s] : cuts[s + 1]]), "sizes": _packed(end[i] - begin[i]), "text": b"".join(texts)}
                    yield pa.RecordBatch.from_pylist([row], pa.schema([("shard", pa.int32()), ("part", pa.int32()), ("lang", pa.string()), *((c, pa.binary()) for c in ("h", "g", "n", "sizes", "text"))]))

    return of


def _numbered(code: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``_distinct``, for numbers below ``size``."""
    times, last = np.bincount(code, minlength=size), np.zeros(size, np.int64)
    last[code] = np.arange(len(code))
    seen = times > 0
    return last[seen], (np.cumsum(seen) - 1)[code], times[seen]


def _distinct(code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A place of each distinct value, the number of each row's value, and how often each occurs."""
    order = np.argsort(code, kind="stable")
    ordered = code[order]
    new = np.r_[True, ordered[1:] != ordered[:-1]] if len(code) else np.zeros(0, bool)
    dense = np.empty(len(code), np.int64)
    dense[order] = np.cumsum(new) - 1
    return order[new], dense, np.bincount(dense, minlength=int(new.sum()))


def _lanes(h: np.ndarray) -> np.ndarray:
    """Keys as the perfect hash wants them."""
    second = _mixed(h, np.full(len(h), 1, np.uint64))
    return np.stack([_mixed(h, np.full(len(h), 2, np.uint64)), second, _mixed(second, h), h], axis=1)


def _build(table: pa.Table) -> pa.Table:
    h = table.column("h").to_numpy().astype(np.int64).view(np.uint64)
    pilots, slots = build_perfect_hash(_lanes(h))
    return pa.table({"shard": table.column("shard")[:1], "pilots": pa.array([pilots.tobytes()], pa.binary()), "keys": pa.array([h[np.argsort(slots)].tobytes()], pa.binary())})


def _slots(h: np.ndarray, index: pa.Table) -> np.ndarray:
    """The slot of each key; -1 where the slot holds another."""
    slots = find_slots(_lanes(h), np.frombuffer(index.column("pilots")[0].as_py(), np.int32))
    return np.where(np.frombuffer(index.column("keys")[0].as_py(), np.uint64)[slots] == h, slots, -1)


_ASIDE = pa.list_(pa.struct([("h", pa.int64()), ("g", pa.int64()), ("n", pa.int64()), ("lang", pa.string()), ("phrase", pa.string())]))
_COUNTS = "shard int, part int, g binary, n binary, langs array<string>, phrases array<string>, aside array<struct<h: long, g: long, n: long, lang: string, phrase: string>>"


def _in_slots(shard: int, part: int, size: int, slots: np.ndarray, h: np.ndarray, g: np.ndarray, n: np.ndarray, langs: list[str], phrases: list[str], aside: dict) -> pa.Table:
    """One row of counts by slot: of several second hashes in a slot the smallest has it, the others go aside."""
    least = np.full(size, np.iinfo(np.uint64).max)
    np.minimum.at(least, slots, g)
    has = g == least[slots]
    halves = [np.bincount(slots[has], weights=x[has], minlength=size).astype(np.int64) for x in (n & 0xFFFFFFFF, n >> 32)]  # each exact: below 2**53
    named = np.full(size, -1, np.int64)
    named[slots[has]] = np.flatnonzero(has)
    for i in np.flatnonzero(~has).tolist():
        x = aside.setdefault((int(h[i]), int(g[i])), [0, langs[i], phrases[i]])
        x[0] += int(n[i])
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    rest = [{"h": signed(a), "g": signed(b), "n": x, "lang": lang, "phrase": p} for (a, b), (x, lang, p) in aside.items()]
    return pa.table({
        "shard": pa.array([shard], pa.int32()), "part": pa.array([part], pa.int32()), "g": pa.array([least.tobytes()], pa.binary()), "n": pa.array([(halves[0] + (halves[1] << 32)).tobytes()], pa.binary()),
        "langs": pa.array([[langs[i] if i >= 0 else None for i in named.tolist()]], pa.list_(pa.string())), "phrases": pa.array([[phrases[i] if i >= 0 else None for i in named.tolist()]], pa.list_(pa.string())), "aside": pa.array([rest], _ASIDE),
    })


def _bincount(blocks: pa.Table, index: pa.Table) -> pa.Table:
    join = lambda c, kind: np.frombuffer(b"".join(blocks.column(c).to_pylist()), kind)
    h, g = join("h", np.uint64), join("g", np.uint32).astype(np.uint64)
    lengths = [len(x) // 8 for x in blocks.column("h").to_pylist()]
    n = np.concatenate([np.zeros(0, np.int64), *(_unpacked(x, k) for x, k in zip(blocks.column("n").to_pylist(), lengths))])
    slots = _slots(h, index)
    member = np.flatnonzero(slots >= 0)
    langs, phrases = [], []
    for lang, sizes, text, k in zip(blocks.column("lang").to_pylist(), blocks.column("sizes").to_pylist(), blocks.column("text").to_pylist(), lengths):
        ends = np.cumsum(_unpacked(sizes, k)).tolist()
        langs += [lang] * len(ends)
        phrases += [text[a:b].decode() for a, b in zip([0, *ends], ends)]
    if len(member) < len(h):
        langs, phrases = [langs[i] for i in member.tolist()], [phrases[i] for i in member.tolist()]
    size = len(index.column("keys")[0].as_py()) // 8
    return _in_slots(index.column("shard")[0].as_py(), index.column("part")[0].as_py(), size, slots[member], h[member], g[member], n[member], langs, phrases, {})


def _summed(table: pa.Table) -> pa.Table:
    """Arrays of one shard, added slot by slot."""
    g = np.concatenate([np.frombuffer(x, np.uint64) for x in table.column("g").to_pylist()])
    n = np.concatenate([np.frombuffer(x, np.int64) for x in table.column("n").to_pylist()])
    size = len(g) // table.num_rows
    langs, phrases = ([x for part in table.column(c).to_pylist() for x in part] for c in ("langs", "phrases"))
    aside: dict = {}
    for x in (x for part in table.column("aside").to_pylist() for x in part):
        aside.setdefault((x["h"] % (1 << 64), x["g"] % (1 << 64)), [0, x["lang"], x["phrase"]])[0] += x["n"]
    used = np.flatnonzero(n > 0)
    keys = np.frombuffer(table.column("keys")[0].as_py(), np.uint64)
    out = _in_slots(table.column("shard")[0].as_py(), table.column("part")[0].as_py(), size, used % size, keys[used % size], g[used], n[used], [langs[i] for i in used.tolist()], [phrases[i] for i in used.tolist()], aside)
    return out.append_column("keys", table.column("keys")[:1])


def _often(least: int):
    """(lang, phrase, a) of the phrases of an index that occur often enough, in slots and aside."""

    def of(batches):
        for batch in slices(batches, 1):
            if batch.num_rows:
                row = batch.to_pylist()[0]
                n = np.frombuffer(row["n"], np.int64)
                found = [(row["langs"][i], row["phrases"][i], int(n[i])) for i in np.flatnonzero(n >= least).tolist()]
                found += [(x["lang"], x["phrase"], x["n"]) for x in row["aside"] if x["n"] >= least]
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], kind) for i, kind in enumerate((pa.string(), pa.string(), pa.int64()))], ["lang", "phrase", "a"])

    return of


def _keys(of_words: np.ndarray, width: int) -> np.ndarray:
    """The keys of phrases from their words' values, a row for each phrase."""
    x = of_words[:, 0]
    for k in range(1, of_words.shape[1]):
        x = _mixed(x, of_words[:, k]) & np.uint64((1 << width) - 1)
    return x


def _questions(shards: int, width: int):
    """(shard, lang, phrase, a, cut, first, h, g): the keys of both parts of each cut of each phrase."""

    def of(batches):
        for batch in slices(batches, 4096):
            out = []
            pieces = defaultdict(list)  # by language and number of words
            for lang, phrase, a in zip(*(batch.column(i).to_pylist() for i in range(3))):
                words = phrase.encode().split(b" ")
                for k in range(1, len(words)):
                    for first, piece in ((True, words[:k]), (False, words[k:])):
                        pieces[lang, len(piece)].append((len(out), piece))
                        out.append((lang, phrase, a, k, first))
            h, g = np.zeros(len(out), np.uint64), np.zeros(len(out), np.uint64)
            for (lang, n), asked in pieces.items():
                words = Vocabulary(lang, width)
                ids = words.numbers([w for _, piece in asked for w in piece]).reshape(-1, n)
                at = np.array([i for i, _ in asked])
                h[at], g[at] = _keys(words.values(0)[ids], width), _keys(words.values(1)[ids], 64) & np.uint64(_SECOND)
            if out:
                kinds = (pa.string(), pa.string(), pa.int64(), pa.int32(), pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array((h % np.uint64(shards)).astype(np.int32)), *(pa.array([x[i] for x in out], kind) for i, kind in enumerate(kinds)), pa.array(h.view(np.int64)), pa.array(g.view(np.int64))], ["shard", "lang", "phrase", "a", "cut", "first", "h", "g"])

    return of


def _cut_counts(rows: pa.Table, index: pa.Table) -> pa.Table:
    h, g = (rows.column(c).to_numpy().astype(np.int64).view(np.uint64) for c in ("h", "g"))
    stored, counts = np.frombuffer(index.column("g")[0].as_py(), np.uint64), np.frombuffer(index.column("n")[0].as_py(), np.int64)
    slots = _slots(h, index)
    f = np.where((slots >= 0) & (stored[slots] == g), counts[slots], 0)
    aside = {(x["h"], x["g"]): x["n"] for x in index.column("aside")[0].as_py()}
    if aside:
        f = f + np.array([aside.get((int(a), int(b)), 0) for a, b in zip(h.view(np.int64), g.view(np.int64))], np.int64)
    return rows.select(["lang", "phrase", "a", "cut", "first"]).append_column("f", pa.array(f, pa.int64()))


def _dealt(rows: DataFrame, index: DataFrame, rows_at_most: int):
    """``rows`` and ``index`` grouped by (shard, part): shards with many rows are copied, so that a group has some ``rows_at_most`` of them."""
    sizes = rows.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / rows_at_most).cast("int").alias("parts"))
    salted = rows.join(sizes, "shard").withColumn("part", F.pmod(F.xxhash64(*(c for c in rows.columns if c != "shard")), F.col("parts")).cast("int")).drop("parts")
    copies = index.join(sizes, "shard").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    return salted.groupBy("shard", "part").cogroup(copies.groupBy("shard", "part"))


def phrase_index(texts: DataFrame, heavy: DataFrame, marks, longest: int, chunk: int, held: int, shard: int, rows_at_most: int, width: int) -> tuple[DataFrame, int]:
    """The candidates' perfect hashes with their counts and words by slot, a row for each shard, written to the shared folder; and the number of shards."""
    tasks = texts.rdd.getNumPartitions()
    candidates, sent = heavy.agg(F.countDistinct("h"), F.coalesce(F.sum(F.least("n", F.lit(tasks))), F.lit(0))).first()
    shards = max(1, -(-candidates // shard))
    parts = max(1, -(-sent // (shards * rows_at_most)))  # what a shard gets doesn't grow with the input, as the shards do
    # the hash is unsigned here as in the blocks
    of = F.pmod(F.pmod("h", F.lit(shards)) + F.when(F.col("h") < 0, F.lit((1 << 64) % shards)).otherwise(0), F.lit(shards)).cast("int")
    index = materialize(heavy.select("h").distinct().select(of.alias("shard"), "h").groupBy("shard").applyInArrow(_build, "shard int, pilots binary, keys binary"), "phrase-slots")
    copies = index.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    blocks = texts.mapInArrow(_blocks(marks, shards, parts, longest, chunk, held, width), _BLOCK)
    counts = blocks.groupBy("shard", "part").cogroup(copies.groupBy("shard", "part")).applyInArrow(_bincount, _COUNTS)
    counts = materialize(counts, "phrase-counts")
    while parts > 1:
        parts = -(-parts // FAN_IN)
        with_keys = counts.join(index.select("shard", "keys"), "shard").withColumn("part", F.floor(F.col("part") / FAN_IN).cast("int"))
        counts = with_keys.groupBy("shard", "part").applyInArrow(_summed, f"{_COUNTS}, keys binary").drop("keys")
    return materialize(index.join(counts.drop("part"), "shard"), "phrase-index"), shards


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, top: int = TOP, contained: int = CONTAINED, longest: int = LONGEST, bits: int = BITS, shard: int = SHARD, rows_at_most: int = ROWS, chunk: int = CHUNK, held: int = HELD, width: int = WIDTH) -> DataFrame:
    """The ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    a, l and r count the phrase and the two parts of its weakest cut, n all words
    of the language; ``bits`` is a power of two and 2**18 at least.
    """
    texts = docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"), text_of(F.col(f"`{text_col}`").cast("string")).cast("binary").alias("text"))
    marks = bytearray(bits // 8)
    scans = [_mark(texts, lengths, marks, least, chunk, held, width) for lengths in ((1,), (2,), tuple(range(3, longest + 1)))]
    totals = scans[0].filter("lang IS NOT NULL").select("lang", "n")
    heavy = scans[0].unionByName(scans[1]).unionByName(scans[2]).filter("lang IS NULL").groupBy("h").agg(F.sum("n").alias("n"))
    known = texts.sparkSession.sparkContext.broadcast(bytes(marks))
    index, shards = phrase_index(texts, heavy, known, longest, chunk, held, shard, rows_at_most, width)

    counted = index.select("n", "langs", "phrases", "aside").mapInArrow(_often(least), "lang string, phrase string, a long")
    often = materialize(counted.withColumn("w", F.split("phrase", " ")).filter(F.size("w") > 1), "candidates")
    asked = often.select("lang", "phrase", "a").mapInArrow(_questions(shards, width), "shard int, lang string, phrase string, a long, cut int, first boolean, h long, g long")
    cuts = _dealt(materialize(asked, "cuts"), index, rows_at_most).applyInArrow(_cut_counts, "lang string, phrase string, a long, cut int, first boolean, f long")
    join = lambda start, size: f"array_join(slice(w, {start}, {size}), ' ')"
    inside = often.filter("size(w) > 2").select("lang", F.col("a").alias("longer"), F.explode(F.expr(f"flatten(transform(sequence(2, size(w) - 1), n -> transform(sequence(1, size(w) - n + 1), i -> {join('i', 'n')})))")).alias("phrase"))
    none = F.lit(None)
    rows = cuts.select("lang", "phrase", "a", "cut", "first", "f", none.cast("long").alias("longer")).union(inside.select("lang", "phrase", none.cast("long"), none.cast("int"), none.cast("boolean"), none.cast("long"), "longer"))
    part = lambda k, first: F.max(F.when((F.col("cut") == k) & (F.col("first") == first), F.col("f")))
    one = rows.groupBy("lang", "phrase").agg(F.max("a").alias("a"), F.max("longer").alias("longer"), *(part(k, first).alias(f"{side}{k}") for k in range(1, longest) for side, first in (("l", True), ("r", False))))
    scored = F.expr(f"array_min(array({', '.join(f'if(l{k} is null, null, struct(cast(2000000 as decimal(7,0)) * cast(a as decimal(20,0)) div (cast(l{k} as decimal(20,0)) + cast(r{k} as decimal(20,0))) as score, {k} as k, l{k} as l, r{k} as r))' for k in range(1, longest))}))")
    kept = one.filter(F.expr(f"a is not null and not coalesce(cast(100 as decimal(3,0)) * cast(longer as decimal(20,0)) >= cast({contained} as decimal(3,0)) * cast(a as decimal(20,0)), false)"))
    ranked = materialize(kept.select("lang", "phrase", "a", scored.alias("s")).select("lang", "phrase", "a", "s.l", "s.r", "s.score"), "collocations")
    best = _top(ranked, top, rows_at_most)
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def _top(rows: DataFrame, top: int, rows_at_most: int) -> DataFrame:
    """The first ``top`` rows of each language with their rank: the best of parts of the rows, then the best of these."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    parts = -(-rows.count() // rows_at_most)
    while parts > 1:
        own = F.pmod(F.xxhash64("phrase"), F.lit(parts))
        rows = rows.withColumn("part", own).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("rank") <= top).drop("part", "rank")
        parts = min(parts // 2, -(-parts * top // rows_at_most))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)


SQL = rf"""
    WITH pieces AS (SELECT row_number() OVER () AS p, lang, piece FROM (SELECT coalesce(lang, 'und') AS lang,
            unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
    words AS MATERIALIZED (SELECT p, lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x != '') AS w FROM pieces),
    starts AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM words),
    counted AS (SELECT lang, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f FROM (SELECT lang, w, i, unnest(range(1, least({LONGEST}, len(w) - i + 1) + 1)) AS k FROM starts) GROUP BY 1, 2 HAVING count(*) >= {LEAST}),
    f AS MATERIALIZED (SELECT lang, phrase, f, string_split(phrase, ' ') AS w, len(string_split(phrase, ' ')) AS k FROM counted),
    parts AS MATERIALIZED (SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS left_part, array_to_string(w[k + 1:], ' ') AS right_part FROM (SELECT lang, phrase, f AS a, w, unnest(range(1, len(w))) AS k FROM f)),
    cuts AS (SELECT c.lang, c.phrase, c.a, c.k, l.f AS l, r.f AS r, (2000000::HUGEINT * c.a) // (l.f + r.f) AS score FROM parts c
        JOIN f l ON l.lang = c.lang AND l.phrase = c.left_part JOIN f r ON r.lang = c.lang AND r.phrase = c.right_part),
    best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
    inside AS (SELECT lang, phrase, max(f) AS f FROM (SELECT lang, f, array_to_string(w[i:i + n - 1], ' ') AS phrase FROM f, range(2, {LONGEST}) a(n), range(1, {LONGEST}) b(i) WHERE n < k AND i + n - 1 <= k) GROUP BY 1, 2),
    ranked AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank FROM best b LEFT JOIN inside i ON i.lang = b.lang AND i.phrase = b.phrase
        WHERE i.f IS NULL OR NOT 100::HUGEINT * i.f >= {CONTAINED}::HUGEINT * a)
    SELECT ranked.lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked JOIN (SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang) USING (lang) WHERE rank <= {TOP}"""
