"""Secret scan: fixed patterns, and strings that a primed compressor finds new.

Patterns (kinds ``assign``, ``access``, ``hex``) give the base spans.  The method
adds kind ``novel``: near a sensitive word, each string of key characters with
letters and digits is a candidate, on other lines too; strings that follow one
another with only white space between, as in a PEM body, are near if one is, and
parts joined by dots are one string.  Zstandard, primed with a dictionary of code
and identifiers, packs the code around the candidate with and without it; the
difference is the candidate's marginal size.  The dictionary holds the words of
which identifiers near sensitive words are made, the most frequent of all
documents, besides a fixed beginning.  Names, paths and words in use nearby cost little;
random keys cost nearly all of their bytes, and are reported.

Spans are in code points, the end exclusive.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, slices

# The patterns of the base spans, and the least lengths that keep a match.
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "novel")
ASSIGN_CHARS, ACCESS_CHARS, HEX_CHARS = 8, 16, 32

_LONG_HEX = re.compile(r"[0-9a-f]{32,}")  # the greedy matches of HEX that are kept
_ASSIGN_SIGNS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_SENSITIVE = re.compile(r"(?ai:passw(?:or)?d|passwd|pwd|secret|token|(?:api|access|private|signing|encryption)[ _-]?key|auth(?:orization)?|credential|bearer|signature)")
_KEY_RUN = re.compile(r"[A-Za-z0-9+/_=-]{16,}(?:\.[A-Za-z0-9+/_=-]{16,})*")
#: The words of identifiers: no longer than a candidate, so no key becomes known by its copies.
_IDENTIFIER_WORD = re.compile(r"[A-Z]?[a-z]{3,14}|[A-Z]{4,15}")
_SENSITIVE_SIGNS = ("passw", "pwd", "secret", "token", "key", "auth", "credential", "bearer", "signature")

#: Characters of code on each side of a candidate that count as its surroundings; a sensitive word must be as near.
AROUND = 256
#: Least marginal bytes of a reported candidate, for each that a random string takes.
NOVELTY = 0.9
#: Random strings whose mean size a candidate is held against.
DRAWS = 5
#: Words of identifiers that the dictionary takes from the documents.
DICTIONARY_WORDS = 4096
#: Characters of a candidate that are measured at once.
PIECE = 2048
#: What the compressor knows beforehand: words of code and of configuration.
DICTIONARY = (
    "import from return class public private static final void function const export default module require include "
    "password passwd secret token api_key apikey access_key secret_key private_key public_key auth authorization bearer credential session cookie "
    "username user_name client_id client_secret database connection string host port localhost example placeholder changeme your_token_here "
    "http https://www. .com .org .net /api/v1/ /usr/local/bin /home/user/ /etc/config .json .yaml .xml .properties .env "
    "get_set_is_has_add_remove_create_delete_update_find_list_count_index_value_name_type_id_data_file_path_request_response_service_manager_handler_factory_controller "
    "getPasswordSetTokenUserSecretKeyManagerServiceConfigurationFactoryBuilderHandlerRequestResponseExceptionInterfaceAbstract "
    "0123456789 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 00000000 11111111 xxxxxxxx XXXXXXXX ******** -------- ========"
)


@lru_cache(maxsize=4)
def _compressor(dictionary: str) -> zstandard.ZstdCompressor:
    data = zstandard.ZstdCompressionDict(dictionary.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressor(level=19, dict_data=data, write_content_size=False, write_checksum=False)


def random_like(candidate: str, draw: int = 0) -> str:
    """A string of the same length and kinds of characters, drawn from a hash of the candidate."""
    kinds = ("0123456789abcdef",) if not candidate.strip("0123456789abcdef") else ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    draws = hashlib.shake_256(f"{draw} {candidate}".encode()).digest(2 * len(candidate))
    out = []
    for k, c in enumerate(candidate):
        kind = next((x for x in kinds if c in x), c)
        out.append(kind[int.from_bytes(draws[2 * k : 2 * k + 2]) % len(kind)])
    return "".join(out)


def novelty(before: str, candidate: str, after: str, dictionary: str = DICTIONARY) -> float:
    """Marginal compressed bytes of the candidate in its surroundings, for each byte that a random string of its kind takes there (at most its own bytes).

    In long surroundings the compressor packs any letters into some six bits, random ones too.
    A long candidate is measured in pieces, so that the time stays in proportion to its length.
    """
    packed = _compressor(dictionary).compress
    around = (before + "\n" + after + "\n").encode()
    least = len(packed(around))
    of = lambda x: len(packed(around + x.encode())) - least
    own = most = 0.0
    for at in range(0, len(candidate), PIECE):
        piece = candidate[at : at + PIECE]
        usual = sum(of(random_like(piece, k)) for k in range(DRAWS)) / DRAWS
        own, most = own + of(piece), most + max(1, min(len(piece.encode()), usual))
    return own / most


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, number of kind, end) of the patterns' matches that are long enough, leftmost and non-overlapping for each kind."""
    low, out = text.lower(), []
    if any(s in low for s in _ASSIGN_SIGNS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_CHARS]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_CHARS]
    out += [(m.start(), 2, m.end()) for m in _LONG_HEX.finditer(text)]
    return sorted(out)


def near_runs(text: str, signs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Strings of key characters within ``AROUND`` of one of the sorted signs, and those that adjoin such a string."""
    runs = [m.span() for m in _KEY_RUN.finditer(text)]
    ends, near = [e for _, e in signs], []
    for s, e in runs:
        k = bisect_left(ends, s - AROUND)
        near.append(k < len(signs) and signs[k][0] <= e + AROUND)
    for order in (range(1, len(runs)), range(len(runs) - 2, -1, -1)):
        step = order.step
        for k in order:
            a, b = sorted((k, k - step))
            if near[k - step] and not near[k] and text[runs[a][1] : runs[b][0]].isspace():
                near[k] = True
    return [r for r, ok in zip(runs, near) if ok]


def novel_spans(text: str, base: list[tuple[int, int, int]], dictionary: str = DICTIONARY, least: float = NOVELTY) -> list[tuple[int, int, int]]:
    """Candidates near a sensitive word that the primed compressor cannot shorten and no base span touches."""
    low, out = text.lower(), []
    if not any(s in low for s in _SENSITIVE_SIGNS):
        return out
    signs = [m.span() for m in _SENSITIVE.finditer(text)]
    if not signs:
        return out
    begins, ends = [x[0] for x in base], list(accumulate((x[2] for x in base), max))  # base spans are sorted by their begin
    for s, e in near_runs(text, signs):
        word = text[s:e]
        mixed = any(c.isdigit() for c in word) and any(c.isalpha() for c in word)
        before = bisect_left(begins, e)  # base spans that begin before the candidate ends
        if mixed and not (before and ends[before - 1] > s) and novelty(text[max(0, s - AROUND) : s], word, text[e : e + AROUND], dictionary) >= least:
            out.append((s, 3, e))
    return out


def identifier_words(text: str) -> Counter:
    """Words of identifiers around the sensitive words of a text, each counted once for the text."""
    low = text.lower()
    if not any(s in low for s in _SENSITIVE_SIGNS):
        return Counter()
    found, end = set(), 0
    for m in _SENSITIVE.finditer(text):
        start = max(end, m.start() - AROUND)
        end = max(end, m.end() + AROUND)
        found.update(_IDENTIFIER_WORD.findall(text, start, end))
    return Counter(found)


def corpus_dictionary(rows: DataFrame, words: int = DICTIONARY_WORDS, first: str = DICTIONARY) -> str:
    """``first`` and the words that are near sensitive words in most of (doc_id, text), at most ``words``, the most frequent last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

        for b in slices(batches):
            for text in b.column("text").to_pylist():
                counts.update(identifier_words(text))
            if len(counts) > 100_000:
                yield batch()
                counts.clear()
        yield batch()

    counts = rows.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter("n > 1")
    best = counts.orderBy(F.desc("n"), "word").limit(words).collect()
    return " ".join([first, *(r["word"] for r in reversed(best))])


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def _scan(dictionary: str, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows = []
            for text in b.column("text").to_pylist():
                base = base_spans(text)
                kinds = [k for _, k, _ in base]
                new = novel_spans(text, base, dictionary, least)
                rows.append((kinds.count(0), kinds.count(1), kinds.count(2), hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + new), len(new)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(),) * 3 + (pa.string(),) * 2 + (pa.int64(),)))], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_novel"])

    return run


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", dictionary: str | None = None, least: float = NOVELTY) -> DataFrame:
    """One row for each document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_novel.

    Null and empty texts have no spans; repeated rows are scanned each; an empty
    input gives an empty result; other columns are ignored.  Without ``dictionary``
    it is made from the documents.
    """
    rows = documents(docs, id_col, text_col)
    return rows.mapInArrow(_scan(corpus_dictionary(rows) if dictionary is None else dictionary, least), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_novel long")
