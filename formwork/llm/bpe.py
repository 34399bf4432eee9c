"""BPE encoding and decoding as streaming machines over a public tokenizer's merge list."""

from __future__ import annotations

import codecs
import json
import unicodedata
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from itertools import batched

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formwork.llm.common import text_chunks, type_of

#: White space by Unicode, without the separators U+001C to U+001F that Python adds.
_SPACES = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte: itself where it prints, else the next from U+0100."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = (b for b in range(256) if b not in set(shown))
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Merges:
    """A merge list over token ids: ``pairs`` maps left << 20 | right to rank << 20 | merged."""

    def __init__(self, pairs: dict[int, int], length: dict[int, int]):
        self.pairs, self.length = pairs, length
        self.lookahead = sufficient_lookahead(pairs, length)
        self.longest = max(length.values(), default=1)

    def merge(self, ids: list[int]) -> list[int]:
        """All merges of a whole sequence, lowest rank first, leftmost first."""
        known, none = self.pairs.get, 1 << 62
        found = [known(a << 20 | b, none) for a, b in zip(ids, ids[1:])]
        while found and (best := min(found)) != none:
            i = found.index(best)
            ids[i : i + 2] = [best & 0xFFFFF]
            del found[i]
            if i:
                found[i - 1] = known(ids[i - 1] << 20 | ids[i], none)
            if i < len(found):
                found[i] = known(ids[i] << 20 | ids[i + 1], none)
        return ids

    def stream(self, symbols: Iterable[int], step: int = 64) -> Iterator[int]:
        """Tokens of a sequence of any length, each once no later symbol can change it.

        Holds ``lookahead + longest token + step`` symbols at most: a boundary with ``lookahead``
        known symbols behind it is final, nothing merges across a final boundary, and the first
        boundary lies within the longest token, so that each time something leaves."""
        held: list[int] = []
        room, length = self.lookahead + self.longest + step, self.length
        for part in batched(symbols, step):
            held += part
            if len(held) >= room:
                end, safe = 0, len(held) - self.lookahead
                for t in self.merge(list(held)):
                    if end + length[t] > safe:
                        break
                    end += length[t]
                    yield t
                held = held[end:]
        yield from self.merge(held)


def sufficient_lookahead(pairs: dict[int, int], length: dict[int, int]) -> int:
    """Symbols behind a boundary that decide whether a merge crosses it.

    A merge (u, v) of rank r needs v beside u.  Only a merge of lower rank that takes v, or the right
    end of what v was built from, to the right can prevent that, and this one in turn only a merge of
    yet lower rank beyond it.  The longest such chain, in symbols, suffices."""
    rank = {v & 0xFFFFF: v >> 20 for v in pairs.values()}
    right = {}
    for key, v in sorted(pairs.items(), key=lambda x: x[1] >> 20):
        right.setdefault(v & 0xFFFFF, key & 0xFFFFF)
    ranks: dict[int, list[int]] = {}
    reach: dict[int, list[int]] = {}

    def beyond(token: int, limit: int) -> int:
        """The longest chain of merges below ``limit`` that begins at the right end of ``token``."""
        best, part, until = 0, token, limit
        while True:
            if (i := bisect_left(ranks.get(part, ()), until)) > 0:
                best = max(best, reach[part][i - 1])
            if part not in right:
                return best
            until = min(until, rank[part])
            part = right[part]

    for key, v in sorted(pairs.items(), key=lambda x: x[1] >> 20):
        a, b, r = key >> 20, key & 0xFFFFF, v >> 20
        far = length[b] + beyond(b, r)
        before = reach.setdefault(a, [])
        ranks.setdefault(a, []).append(r)
        before.append(max(far, before[-1] if before else 0))
    return max((x[-1] for x in reach.values()), default=0)


class Tokenizer:
    """A byte-level BPE tokenizer with word ends, read from a tokenizers JSON file.

    Supports what such files hold: NFC and lower-casing normalisers, white space folding (which
    divides words only), a removing regex split with byte-level letters, an end-of-word suffix, and
    special tokens that are found in the raw text.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        letters = _byte_letters()
        self.inner = [vocab[letters[b]] for b in range(256)]
        self.final = [vocab[letters[b] + suffix] for b in range(256)]
        length = {t: 1 for t in (*self.inner, *self.final)}
        pairs: dict[int, int] = {}
        for r, m in enumerate(model["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            new = vocab[a + b]
            length[new] = length[vocab[a]] + length[vocab[b]]
            pairs[vocab[a] << 20 | vocab[b]] = r << 20 | new
        self.merges = Merges(pairs, length)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.named = {i: b" " + t.encode() for i, t in self.names.items()}
        self.bytes = {i: b"" for i in self.special.values()}
        back = {c: b for b, c in letters.items()}
        for t, i in vocab.items():
            if i not in self.bytes:
                self.bytes[i] = bytes(back[c] for c in t.removesuffix(suffix)) + b" " * (bool(suffix) and t.endswith(suffix))
        steps = spec["normalizer"]["normalizers"] if spec["normalizer"] else []
        self.nfc, self.lower = (any(s["type"] == kind for s in steps) for kind in ("NFC", "Lowercase"))
        pattern = next(s["pattern"]["Regex"] for s in spec["pre_tokenizer"]["pretokenizers"] if s["type"] == "Split")
        self.split = regex.compile(pattern.replace(r"[^\s", f"[^{_SPACES}"))
        self.divide = regex.compile("(" + "|".join(regex.escape(t) for t in self.special) + ")") if self.special else None
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def pieces(self, text: str) -> Iterator[str | int]:
        """Words of the text in order; special tokens as ids."""
        for i, part in enumerate(self.divide.split(text) if self.divide else [text]):
            if i % 2:
                yield self.special[part]
                continue
            if self.nfc and not part.isascii():
                part = unicodedata.normalize("NFC", part)
            if self.lower:
                part = part.replace("Σ", "σ").lower()
            yield from self.split.findall(part)

    def _tokens(self, word: str) -> bytes:
        """A word's ids, by the transducer."""
        raw = word.encode("utf-8")
        inner = self.inner
        symbols = [inner[b] for b in raw]
        symbols[-1] = self.final[raw[-1]]
        return np.fromiter(self.merges.stream(symbols), np.int32).tobytes()

    def encode(self, text: str, keep: int = 400_000) -> bytes:
        """Token ids as int32 bytes.  Up to ``2 * keep`` words' tokens are remembered."""
        out = []
        known, older = self.known, self.older
        for piece in self.pieces(text):
            if (ids := known.get(piece)) is None:
                if isinstance(piece, int):
                    ids = np.int32(piece).tobytes()
                elif (ids := older.get(piece)) is None:
                    ids = self._tokens(piece)
                if isinstance(piece, int) or len(piece) < 100:
                    if len(known) >= keep:
                        self.older, self.known = known, {}
                        known, older = self.known, self.older
                    known[piece] = ids
            out.append(ids)
        return b"".join(out)


class Decoder:
    """Turns ids to text, some at a time: an incremental byte-to-text state machine.

    Each id gives bytes, and text leaves as soon as a character's bytes are complete; bytes that
    form none become U+FFFD.  ``joined``: the bytes are those of token names with a space between
    two, as the library has it for files that name no decoder; otherwise those the tokens stand for."""

    def __init__(self, tokenizer: Tokenizer, joined: bool = True):
        self.of, self.joined, self.begun = tokenizer.named if joined else tokenizer.bytes, joined, False
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, tokens: Iterable[int]) -> str:
        raw = b"".join(map(self.of.__getitem__, tokens))
        if self.joined and raw and not self.begun:
            self.begun, raw = True, raw[1:]
        return self.state.decode(raw)

    def end(self) -> str:
        return self.state.decode(b"", final=True)

    def text(self, ids: list[int], step: int = 4096) -> str:
        """The whole text of ``ids``, fed ``step`` at a time."""
        return "".join([*map(self.feed, batched(ids, step)), self.end()])


_loaded: dict[str, Tokenizer] = {}


def loaded(path: str) -> Tokenizer:
    """The tokenizer of a file, read once by each worker."""
    if path not in _loaded:
        _loaded[path] = Tokenizer(path)
    return _loaded[path]


def encode(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, ids``: the token ids of each whole text, without added special tokens.

    ``path`` is the tokenizer's file, at the same place on each executor.  Every word goes through a
    transducer with bounded lookahead (``Merges.stream``), so a word of any length needs constant
    memory beside its ids; a word seen before is looked up.  A null text is empty and has no ids;
    ids keep their type; repeated rows stay; an empty table gives no rows; other columns are ignored.
    """

    def rows(batches) -> Iterator[pa.RecordBatch]:
        tokenizer = loaded(path)
        for part, chunk in text_chunks(batches, 1 << 20):
            found = [tokenizer.encode(t.decode("utf-8")) for t in chunk]
            offsets = np.cumsum([0, *(len(x) // 4 for x in found)]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(found), np.int32)))
            yield pa.RecordBatch.from_arrays([part.column(0), ids], ["doc_id", "ids"])

    whole = F.coalesce(F.col(text_column), F.lit("")).alias("text")
    texts = docs.select(F.col(id_column).alias("doc_id"), whole)
    return texts.mapInArrow(rows, f"doc_id {type_of(texts, 'doc_id')}, ids array<int>")


def decode(encoded: DataFrame, path: str, joined: bool = True) -> DataFrame:
    """``doc_id, ids, decoded`` from ``doc_id, ids``: each row's ids through a ``Decoder``.

    Null or empty ids give an empty text; an id that the file doesn't have is an error."""

    def rows(batches) -> Iterator[pa.RecordBatch]:
        tokenizer = loaded(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [Decoder(tokenizer, joined).text(ids.values.to_pylist() if ids.is_valid else []) for ids in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], ["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(rows, f"doc_id {type_of(encoded, 'doc_id')}, ids array<int>, decoded string")
