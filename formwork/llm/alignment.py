"""Alignment of two tokenizers: which tokens of one end where tokens of the other do.

A byte-level BPE (A, a ``tokenizers`` file) and a piece BPE (B, a ``sentencepiece`` model) encode the
same bytes: a space and the text.  Byte offsets where tokens of both end cut the bytes into groups;
an A token and a B token that end together are linked.

Texts are sliced before single spaces between visible characters.  Neither tokenizer has a token
across such a place: A's pattern begins a word at the space, and no piece of B has a space behind
another character (checked when the model is loaded; else texts aren't sliced).  So a slice encodes
alone as it does in its text, each distinct slice of a batch is encoded and aligned once, and what
is known of slices is added up for the texts.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formwork.llm.common import text_chunks, type_of

#: A pair of ids as one number.
_SHIFT = 21
#: Slices that are encoded at a time: plain ones together, and others.
_PLAIN, _OTHER = 4_000, 2_000
#: Bytes of a plain slice at most.
_SHORT = 200
_SPACE = "▁"


def _byte_of() -> dict[str, int]:
    """The byte for each character of a byte-level vocabulary: visible Latin-1 characters stand for
    themselves, the other bytes for the characters from 256 on, in order."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(visible)]
    return {**{chr(b): b for b in visible}, **{chr(256 + i): b for i, b in enumerate(rest)}}


class Pair:
    """Both tokenizers with the bytes of their tokens."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        with open(a_path, encoding="utf-8") as f:
            spec = json.load(f)
        self.a = Tokenizer.from_str(json.dumps(spec))
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        byte_of = _byte_of()
        self.a_bytes = [b""] * (1 + max(spec["model"]["vocab"].values(), default=0))
        for token, i in spec["model"]["vocab"].items():
            self.a_bytes[i] = bytes(byte_of[c] for c in token)
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(_SPACE, " ").encode() for i, p in enumerate(pieces)]
        pre = spec.get("pre_tokenizer") or {}
        plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not spec.get("normalizer")
        self.sliced = plain and not any(_SPACE in p.lstrip(_SPACE) for p in pieces)
        self.fast = self._ranked(spec) if self.sliced else None
        self.a_len, self.b_len = (np.fromiter(map(len, x), np.int64, len(x)) for x in (self.a_bytes, self.b_bytes))
        assert max(len(self.a_len), len(self.b_len)) < 1 << _SHIFT

    def _ranked(self, spec: dict):
        """A as a ``tiktoken`` encoding, several times as fast for short slices: where each merge makes the next
        id, the ids are its ranks.  None where they aren't."""
        import public_tokenizers
        import tiktoken

        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        first = len(vocab) - len(pairs)
        if first != 256 or any(vocab.get(x + y) != first + i for i, (x, y) in enumerate(pairs)):
            return None
        return tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks={x: i for i, x in enumerate(self.a_bytes)}, special_tokens={})

    def together(self, whole: bytes, sizes: np.ndarray) -> tuple | None:
        """A's ids and B's ids of plain slices in a row, as of one text: no token crosses from one to the next.
        None if the tokens don't give the bytes back."""
        text = whole.decode("utf-8", "replace")
        a, b = self.fast.encode_ordinary(text) if self.fast else self.a.encode(text, add_special_tokens=False).ids, self.b.encode(text[1:], num_threads=1)
        if any(b"".join(map(names.__getitem__, ids)) != whole for ids, names in ((a, self.a_bytes), (b, self.b_bytes))):
            return None
        return np.array(a, np.int64), np.array(b, np.int64), np.ones(len(sizes), bool)

    def alone(self, slices: list[bytes]) -> tuple:
        """A's ids and B's ids of slices encoded one by one, and whether both give the slice's bytes.  Slices
        of other bytes, or of none but the space, have no ids."""
        texts = [s.decode("utf-8", "replace") for s in slices]
        a = [x.ids for x in self.a.encode_batch(texts, add_special_tokens=False)]
        b = self.b.encode([t[1:] for t in texts], num_threads=1)
        good = [len(s) > 1 and b"".join(map(self.a_bytes.__getitem__, x)) == s and b"".join(map(self.b_bytes.__getitem__, y)) == s for s, x, y in zip(slices, a, b)]
        return *(np.array([i for x, g in zip(ids, good) if g for i in x], np.int64) for ids in (a, b)), np.array(good, bool)


@lru_cache(2)
def pair_of(a_path: str, b_path: str) -> Pair:
    return Pair(a_path, b_path)


def pairs_at_most(a_path: str, b_path: str) -> int:
    """A bound on pairs of ids that can be linked, whatever the texts: of two tokens that end
    together one is an ending of the other, and a token has no more endings than bytes."""
    held = pair_of(a_path, b_path)
    return int(held.a_len.sum() + held.b_len.sum())


def align(a: np.ndarray, b: np.ndarray, a_len: np.ndarray, b_len: np.ndarray) -> tuple[np.ndarray, ...]:
    """For two encodings of the same bytes, ids ``a`` and ``b`` of the given lengths: the byte
    offsets where tokens of both end, the group of each token of A and of B, and the links as
    places in ``a``, in ``b`` and in the cuts."""
    a_ends, b_ends = np.cumsum(a_len), np.cumsum(b_len)
    cuts = np.intersect1d(a_ends, b_ends, assume_unique=bool(a_len.all() and b_len.all()))
    a_low, b_low = np.searchsorted(a_ends, cuts), np.searchsorted(b_ends, cuts)
    a_n, b_n = np.searchsorted(a_ends, cuts, "right") - a_low, np.searchsorted(b_ends, cuts, "right") - b_low
    times = a_n * b_n  # 1, but for tokens without bytes
    cut = np.repeat(np.arange(len(cuts)), times)
    k = np.arange(len(cut)) - np.repeat(np.cumsum(times) - times, times)
    return cuts, np.searchsorted(cuts, a_ends), np.searchsorted(cuts, b_ends), a_low[cut] + k // b_n[cut], b_low[cut] + k % b_n[cut], cut


@dataclass
class Facts:
    """What is found of some distinct slices: whether each aligns, how many tokens, groups and links
    it has, all links as pair numbers, and the groups as text (if asked for)."""

    good: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    links: np.ndarray
    groups: list[str]


def _facts(held: Pair, slices: pa.Array, together: bool, texts: bool) -> Facts:
    """The facts of some slices; ``together``: they are plain."""
    offsets = np.frombuffer(slices.buffers()[1], np.int32)[slices.offset : slices.offset + len(slices) + 1]
    sizes = np.diff(offsets).astype(np.int64)
    found = held.together(slices.buffers()[2].slice(offsets[0], offsets[-1] - offsets[0]).to_pybytes(), sizes) if together else None
    a, b, good = found or held.alone(slices.to_pylist())
    cuts, a_group, b_group, a_at, b_at, cut = align(a, b, held.a_len[a], held.b_len[b])
    ends = np.cumsum(np.where(good, sizes, 0))
    within = lambda x: np.diff(np.searchsorted(x, ends, "right"), prepend=0)
    n_a, n_b, n_groups = within(np.cumsum(held.a_len[a])), within(np.cumsum(held.b_len[b])), within(cuts)
    groups = _texts(a, b, a_group, b_group, n_groups) if texts else []
    return Facts(good, n_a, n_b, n_groups, within(cuts[cut]), (a[a_at] << _SHIFT) | b[b_at], groups)


@lru_cache(1)
def _digits() -> tuple[np.ndarray, np.ndarray]:
    """The decimal digits of ids up to 2**17 from the left, zeros behind them, and how many there are."""
    sizes = np.char.str_len(names := np.arange(1 << 17).astype("S8"))
    return names.view(np.uint8).reshape(-1, 8), sizes


def _texts(a: np.ndarray, b: np.ndarray, a_group: np.ndarray, b_group: np.ndarray, n_groups: np.ndarray) -> list[str]:
    """The ids of each slice by group, as ``a1,a2|b1;a3|b2,b3``."""
    place = np.concatenate([a_group * 2, b_group * 2 + 1])
    order = np.argsort(place, kind="stable")
    ids, place = np.concatenate([a, b])[order], place[order]
    digits, sizes = _digits()
    last = np.diff(place, append=-1) != 0
    marks = np.where(last, np.where(place % 2 == 0, ord("|"), ord(";")), ord(",")).astype(np.uint8)
    if ids.max(initial=0) < len(digits):
        held = digits[ids]
        held[np.arange(len(ids)), sizes[ids]] = marks
        text, width = held[held != 0].tobytes().decode(), sizes[ids] + 1
    else:
        each = [f"{i}{chr(m)}" for i, m in zip(ids.tolist(), marks.tolist())]
        text, width = "".join(each), np.fromiter(map(len, each), np.int64, len(each))
    group_ends = np.cumsum(width)[last & (place % 2 == 1)]
    ends = np.concatenate([[0], group_ends])[np.cumsum(n_groups)].tolist()
    return [text[i : max(i, j - 1)] for i, j in zip([0, *ends], ends)]


_VISIBLE = np.zeros(256, bool)
_VISIBLE[0x21:0x7F] = True


def sliced(texts: list[bytes], cut: bool) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The slices of ``texts``, each text with a space before it, and where each text's begin.

    With ``cut``, slices begin at single spaces between characters that are visible ASCII or U+00C0
    to U+00FF; else a text is one slice."""
    raw = b" " + b" ".join(texts)
    data = np.frombuffer(raw, np.uint8)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    begins = np.cumsum(lengths) - lengths
    starts = begins
    if cut:
        at = np.flatnonzero(data[1:-1] == 32) + 1
        before, after = data[at - 1], data[at + 1]
        at = at[(_VISIBLE[before] | ((before >= 0x80) & (data[at - 2] == 0xC3))) & (_VISIBLE[after] | (after == 0xC3))]
        marks = np.zeros(len(data), bool)
        marks[begins] = marks[at] = True
        starts = np.flatnonzero(marks)
    offsets = np.append(starts, len(data)).astype(np.int32)
    slices = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(raw)])
    return slices.dictionary_encode(), np.searchsorted(starts, begins)


def _plain(slices: pa.Array) -> np.ndarray:
    """Which slices are short, begin with a single space, end visibly and hold only characters up to U+017F:
    both libraries for A know the same letters there, and such slices encode in a row as alone."""
    data, offsets = np.frombuffer(slices.buffers()[2], np.uint8), np.frombuffer(slices.buffers()[1], np.int32)[: len(slices) + 1]
    starts, sizes = offsets[:-1], np.diff(offsets)
    second, before, last = (data[np.clip(i, 0, len(data) - 1)] for i in (starts + 1, offsets[1:] - 2, offsets[1:] - 1))
    begins = (sizes > 1) & (_VISIBLE[second] | (second == 0xC3))
    ends = _VISIBLE[last] | ((last >= 0x80) & (before == 0xC3) & (sizes > 2))
    return begins & ends & (sizes <= _SHORT) & (np.maximum.reduceat(data, starts) < 0xC6)


def _chunks(batches, held: Pair, texts: bool) -> Iterator[tuple]:
    """For each chunk of texts: its rows, its distinct slices' facts, the slice at each place, where
    each text's places begin, and which texts align as a whole."""
    for part, chunk in text_chunks(batches, 8 << 20):
        coded, first = sliced(chunk, held.sliced)
        plain = _plain(coded.dictionary) & held.sliced
        order = np.argsort(~plain, kind="stable")
        place, n = np.empty(len(order), np.int64), int(plain.sum())
        place[order] = np.arange(len(order))
        pieces = [(i, min(n, i + _PLAIN), True) for i in range(0, n, _PLAIN)] + [(i, i + _OTHER, False) for i in range(n, len(order), _OTHER)]
        each = [_facts(held, coded.dictionary.take(pa.array(order[i:j])), together, texts) for i, j, together in pieces]
        found = Facts(*(np.concatenate([getattr(f, c) for f in each]) for c in ("good", "n_a", "n_b", "n_groups", "n_links", "links")), [g for f in each for g in f.groups])
        which = place[coded.indices.to_numpy()]
        yield part, found, which, first, np.logical_and.reduceat(found.good[which], first)


def _added(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order, and the sums of their times."""
    order = np.argsort(keys, kind="stable")
    keys, times = keys[order], times[order]
    first = np.flatnonzero(np.diff(keys, prepend=-1))
    return keys[first], np.add.reduceat(times, first) if len(first) else times


def pair_counts(docs: DataFrame, a_path: str, b_path: str, text_column: str = "text", salts: int = 16) -> DataFrame:
    """``a, b, n``: how many links of all texts hold A's token ``a`` and B's token ``b``.

    Tasks add up their own pairs, which are bounded by ``pairs_at_most``; those of one pair are
    shuffled by pair and salt first, then by pair.  Null, empty and unaligned texts have no links."""

    def count(batches) -> Iterator[pa.RecordBatch]:
        keys, sums = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for _, found, which, first, good in _chunks(batches, pair_of(a_path, b_path), False):
            use = np.repeat(good, np.diff(np.append(first, len(which))))
            often = np.bincount(which[use], minlength=len(found.good))
            keys, sums = _added(np.concatenate([keys, found.links]), np.concatenate([sums, np.repeat(often, found.n_links)]))
        some = sums > 0
        keys, sums = keys[some], sums[some]
        for i in range(0, len(keys), 10_000):
            k = keys[i : i + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array((k >> _SHIFT).astype(np.int32)), pa.array((k & ((1 << _SHIFT) - 1)).astype(np.int32)), pa.array(sums[i : i + 10_000])], ["a", "b", "n"])

    rows = docs.select(F.coalesce(F.col(text_column), F.lit("")).alias("text")).mapInArrow(count, "a int, b int, n long")
    rows = rows.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
    rows = rows.groupBy("a", "b", "salt").agg(F.sum("n").alias("n"))
    return rows.groupBy("a", "b").agg(F.sum("n").alias("n"))


def aligned(docs: DataFrame, a_path: str, b_path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum`` (long) and ``groups`` of each row.

    ``groups`` has the ids of A and B by group, as ``a1,a2|b1;a3|b2,b3``.  A pair's count is how many
    links of all rows hold it (``pair_counts``, which has up to ``pairs_at_most`` rows and so is
    given to the tasks whole); ``count_sum`` adds those of a row's links, and ``n_best`` counts the
    links that have the highest count of their B token, ties included.

    Null and empty texts, and texts that the tokens of A or B don't give back (those with U+2581),
    have no tokens: zeros, and empty ``groups``.  Rows with equal or null ids are rows of their own,
    and repeated texts count as often as they occur.  Texts of any length are sliced; a single run without
    a space is encoded as a whole, in memory that grows with it.  Other columns are ignored, and an
    empty table gives no rows.
    """
    table = pair_counts(docs, a_path, b_path, text_column).toArrow()
    assert table.num_rows <= pairs_at_most(a_path, b_path)
    a, b, n = (table.column(c).to_numpy().astype(np.int64) for c in ("a", "b", "n"))
    order = np.argsort((a << _SHIFT) | b)
    keys, counts = ((a << _SHIFT) | b)[order], n[order]
    top = np.zeros(int(b.max(initial=0)) + 1, np.int64)
    np.maximum.at(top, b, n)
    best = counts == top[b[order]]
    columns = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]

    def rows(batches) -> Iterator[pa.RecordBatch]:
        for part, found, which, first, good in _chunks(batches, pair_of(a_path, b_path), True):
            at = np.searchsorted(keys, found.links)
            at = np.minimum(at, max(0, len(keys) - 1))  # links of unaligned texts may be unknown
            to = np.concatenate([[0], np.cumsum(found.n_links)])
            of = lambda x: np.diff(np.concatenate([[0], np.cumsum(x[at])])[to]) if len(keys) else np.zeros(len(to) - 1, np.int64)
            sums = [np.add.reduceat(x[which], first) * good for x in (found.n_a, found.n_b, found.n_groups, found.n_links, of(best.astype(np.int64)), of(counts))]
            groups = found.groups
            ends = np.append(first[1:], len(which)).tolist()
            where = which.tolist()
            text = [";".join([groups[w] for w in where[i:j]]) if g else "" for i, j, g in zip(first.tolist(), ends, good.tolist())]
            yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, sums), pa.array(text, pa.large_string()).cast(pa.string())], ["doc_id", *columns, "groups"])

    held = docs.select(F.col(id_column).alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    return held.mapInArrow(rows, f"doc_id {type_of(held, 'doc_id')}, {', '.join(f'{c} long' for c in columns)}, groups string")
