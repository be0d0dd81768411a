"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

Encoding follows the sentencepiece library for BPE models with an identity normaliser: a
dummy space goes in front, spaces become the space mark, and of all neighbouring symbols the
pair whose joint piece scores best is merged, leftmost first, until no pair is a piece.
Characters that are no piece become byte pieces (or the unknown id without byte fallback).

No piece has a space mark behind another character (checked when the model is read), so
merges never leave a *word*: space marks and the characters up to the next ones. The words
of many texts that were not met before lie one behind another in flat numpy arrays of
symbols. A round finds the best pair rank of every word (a segmented minimum), merges all
its leftmost places at once and compacts the arrays; words without a pair leave. Merging one
place can make a pair that ranks as well or better, and the library would take that next: in
such a word only the places up to that one are merged in this round. Words that are not done
after ``ROUNDS`` rounds, such as very long ones, go on in a heap of pairs, which gives the
same merges in n log n steps.

Texts are encoded where they are read; nothing is shuffled. The words kept between batches
are ``KEPT_WORDS`` at most.

Behaviour: null text counts as empty and has no ids; null ids decode to an empty text.
Repeated rows and null doc_ids are rows of their own. An empty table gives an empty result.
Columns other than doc_id and the text or ids are not read.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tessera.llm.common import table, text_or_empty

ROUNDS, KEPT_WORDS, SLICE_CHARS = 200, 600_000, 2_000_000
SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
#: Symbols from here on are characters that no piece contains, by code point.
FOREIGN = 1 << 24
NO_PAIR = np.iinfo(np.int32).max


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _replace_bytes(error: UnicodeDecodeError) -> tuple[str, int]:
    return "�" * (error.end - error.start), error.end


codecs.register_error("tessera-byte-wise", _replace_bytes)


class Model:
    """Pieces and pair ranks of a BPE model file, read through the library's own reader."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.vocab_size()
        names = [sp.id_to_piece(i) for i in range(n)]
        kind = [UNKNOWN if sp.is_unknown(i) else CONTROL if sp.is_control(i) else BYTE if sp.is_byte(i) else NORMAL for i in range(n)]
        self.size, self.kind, self.unknown = n, kind, sp.unk_id()
        self.byte_ids = [-1] * 256
        for i in range(n):
            if kind[i] == BYTE:
                self.byte_ids[int(names[i][3:5], 16)] = i
        self.fallback = min(self.byte_ids) >= 0
        normal = {names[i]: i for i in range(n) if kind[i] == NORMAL}
        if any(SPACE in p.lstrip(SPACE) for p in normal):
            raise ValueError("pieces with a space mark inside are not supported")
        #: Every symbol that can occur in a merge: the pieces, then characters that are only parts of pieces.
        self.symbol = dict(normal)
        for c in sorted(set(chain.from_iterable(normal)) - normal.keys()):
            self.symbol[c] = n + len(self.symbol) - len(normal)
        self.char_of = {s: c for c, s in self.symbol.items() if s >= n}
        scores = np.array([sp.get_score(i) for i in normal.values()])
        rank = dict(zip(normal, np.unique(-scores, return_inverse=True)[1].tolist()))
        base = n + len(self.char_of)
        pairs = sorted((self.symbol[p[:k]] * base + self.symbol[p[k:]], rank[p], i) for p, i in normal.items() for k in range(1, len(p)) if p[:k] in self.symbol and p[k:] in self.symbol)
        self.base = base
        self.keys = np.array([*(k for k, _, _ in pairs), np.iinfo(np.int64).max])
        self.ranks = np.array([*(r for _, r, _ in pairs), NO_PAIR], dtype=np.int32)
        self.joint = np.array([*(i for _, _, i in pairs), -1])
        self.pair = {k: (r, i) for k, r, i in pairs}
        self.char_symbol = np.full(0x110000, -1, dtype=np.int64)
        for p, s in self.symbol.items():
            if len(p) == 1:
                self.char_symbol[ord(p)] = s
        surface = {UNKNOWN: lambda i: " ⁇ ".encode(), CONTROL: lambda i: b"", NORMAL: lambda i: names[i].replace(SPACE, " ").encode(), BYTE: lambda i: bytes([int(names[i][3:5], 16)])}
        self.surface = [surface[kind[i]](i) for i in range(n)]
        #: Ids of words met of late, and of those before them.
        self.kept: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and joint piece of pairs of symbols; NO_PAIR where they are no piece."""
        key = np.where((left < self.base) & (right < self.base), left * self.base + right, -1)
        at = np.searchsorted(self.keys, key)
        hit = self.keys[at] == key
        return np.where(hit, self.ranks[at], NO_PAIR), np.where(hit, self.joint[at], -1)

    def merge(self, symbols: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols after all merges, with the numbers of their words, in no order of words. word ascends."""
        done = []
        rank, joint = self._pairs(symbols, word, np.arange(len(symbols)))
        for _ in range(ROUNDS):
            if not len(symbols):
                break
            starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            sizes = np.diff(np.append(starts, len(symbols)))
            least = np.minimum.reduceat(rank, starts)
            if (least == NO_PAIR).any():
                live = np.repeat(least != NO_PAIR, sizes)
                done.append((symbols[~live], word[~live]))
                symbols, word, rank, joint = symbols[live], word[live], rank[live], joint[live]
                sizes, least = sizes[least != NO_PAIR], least[least != NO_PAIR]
                if not len(symbols):
                    break
            best = np.repeat(least, sizes)
            place, spot = rank == best, np.arange(len(symbols))
            head = place & ~np.append(False, place[:-1])
            chain_start = np.maximum.accumulate(np.where(head, spot, 0))
            chosen = np.flatnonzero(place & ((spot - chain_start) % 2 == 0))
            chosen = self._undisturbed(symbols, word, joint, best, chosen)
            symbols = symbols.copy()
            symbols[chosen] = joint[chosen]
            stays = np.ones(len(symbols), bool)
            stays[chosen + 1] = False
            changed = np.zeros(len(symbols), bool)
            changed[chosen] = True
            symbols, word, rank, joint, changed = symbols[stays], word[stays], rank[stays], joint[stays], changed[stays]
            changed[:-1] |= changed[1:]
            at = np.flatnonzero(changed)
            rank[at], joint[at] = self._pairs(symbols, word, at)
        if len(symbols):
            for a, b in zip(*self._bounds(word)):
                rest = self.merge_by_heap(symbols[a:b].tolist())
                done.append((np.array(rest, dtype=np.int64), np.full(len(rest), word[a])))
        if not done:
            return symbols, word
        return np.concatenate([s for s, _ in done]), np.concatenate([w for _, w in done])

    def _pairs(self, symbols: np.ndarray, word: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and joint piece of the pairs that begin at some places; a word's last symbol begins none."""
        if not len(at):
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        after = np.minimum(at + 1, len(symbols) - 1)
        rank, joint = self.find(symbols[at], symbols[after])
        return np.where((after > at) & (word[after] == word[at]), rank, NO_PAIR), joint

    @staticmethod
    def _bounds(word: np.ndarray) -> tuple[list[int], list[int]]:
        cuts = np.flatnonzero(word[1:] != word[:-1]) + 1
        return [0, *cuts.tolist()], [*cuts.tolist(), len(word)]

    def _undisturbed(self, symbols: np.ndarray, word: np.ndarray, joint: np.ndarray, best: np.ndarray, chosen: np.ndarray) -> np.ndarray:
        """Of the chosen places those to merge now: in a word that has several, up to the first whose new pairs rank as well or better."""
        own = word[chosen]
        again = own[1:] == own[:-1]
        several = np.append(again, False) | np.append(False, again)
        if not several.any():
            return chosen
        some = chosen[several]
        last, own, made = len(symbols) - 1, own[several], joint[some]
        before, after = np.maximum(some - 1, 0), np.minimum(some + 2, last)
        left = symbols[before]
        follows = np.flatnonzero(some[1:] == some[:-1] + 2) + 1  # the left neighbour has just been merged
        left[follows] = made[follows - 1]
        new_left = np.where((some > 0) & (word[before] == own), self.find(left, made)[0], NO_PAIR)
        new_right = np.where((some + 2 <= last) & (word[after] == own), self.find(made, symbols[after])[0], NO_PAIR)
        bad = np.minimum(new_left, new_right) <= best[some]
        count = np.cumsum(bad) - bad  # disturbing places before
        starts = np.append(True, own[1:] != own[:-1])
        at_start = np.maximum.accumulate(np.where(starts, np.arange(len(own)), 0))
        keep = np.ones(len(chosen), bool)
        keep[several] = count == count[at_start]
        return chosen[keep]

    def merge_by_heap(self, symbols: list[int]) -> list[int]:
        """The same merges one by one, for one word."""
        n = len(symbols)
        prev, after = list(range(-1, n - 1)), [*range(1, n), -1]
        get, base = self.pair.get, self.base
        heap: list[tuple] = []

        def push(a: int, b: int) -> None:
            if a >= 0 and b >= 0 and symbols[a] < base and symbols[b] < base and (hit := get(symbols[a] * base + symbols[b])):
                heapq.heappush(heap, (hit[0], a, b, symbols[a], symbols[b], hit[1]))

        for a in range(n - 1):
            push(a, a + 1)
        while heap:
            _, a, b, left, right, made = heapq.heappop(heap)
            if symbols[a] != left or symbols[b] != right or after[a] != b:
                continue
            symbols[a], symbols[b], after[a] = made, -1, after[b]
            if after[a] >= 0:
                prev[after[a]] = a
            push(prev[a], a)
            push(a, after[a])
        return [s for s in symbols if s >= 0]

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Ids (32-bit, of the machine's order) of words; each stands for itself behind a space mark, and spaces in it are space marks."""
        if not words:
            return []
        spelled = SPACE + SPACE.join(words).replace(" ", SPACE)
        points = np.frombuffer(spelled.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        symbols = self.char_symbol[points]
        symbols = np.where(symbols < 0, FOREIGN + points, symbols)
        merged, word = self.merge(symbols, np.repeat(np.arange(len(words)), [len(w) + 1 for w in words]))
        order = np.argsort(word, kind="stable")
        merged, word = merged[order], word[order]
        odd = np.flatnonzero(merged >= self.size)
        if len(odd):
            spelt = [self._spelt(s) for s in merged[odd].tolist()]
            times = np.ones(len(merged), np.int64)
            times[odd] = list(map(len, spelt))
            at = (np.cumsum(times) - times)[odd]
            merged, word = np.repeat(merged, times), np.repeat(word, times)
            for k, ids in zip(at.tolist(), spelt):
                merged[k : k + len(ids)] = ids
        raw, ends = merged.astype(np.int32).tobytes(), (4 * np.cumsum(np.bincount(word, minlength=len(words)))).tolist()
        return [raw[a:b] for a, b in zip([0, *ends], ends)]

    def _spelt(self, symbol: int) -> list[int]:
        """Ids of a character that is no piece."""
        char = self.char_of[symbol] if symbol < FOREIGN else chr(symbol - FOREIGN)
        return [self.byte_ids[b] for b in char.encode("utf-8", "surrogatepass")] if self.fallback else [self.unknown]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        split = []
        for text in texts:
            text = f" {text.replace(SPACE, ' ')}" if text else ""
            split.append(re.findall(r" ( *[^ ]*)", text) if "  " in text else text.split(" ")[1:])
        needed = set(chain.from_iterable(split)) - self.kept.keys()
        met = needed & self.older.keys()
        self.kept.update((w, self.older[w]) for w in met)
        new = list(needed - met)
        self.kept.update(zip(new, self.encode_words(new)))
        out = [np.frombuffer(b"".join(map(self.kept.__getitem__, words)), np.int32) for words in split]
        if len(self.kept) > KEPT_WORDS // 2:
            self.older, self.kept = self.kept if len(self.kept) <= KEPT_WORDS else {}, {}
        return out

    def decode(self, ids: list[int]) -> str:
        """Text of ids: the first piece that is not a control one loses one space mark, and bytes that are no UTF-8 become U+FFFD each."""
        raw = b"".join(map(self.surface.__getitem__, ids))
        first = next((i for i in ids if self.kind[i] != CONTROL), None)
        if first is not None and self.kind[first] == NORMAL and raw[:1] == b" ":
            raw = raw[1:]
        return raw.decode("utf-8", "tessera-byte-wise")


@lru_cache(maxsize=1)
def model_of(path: str) -> Model:
    """The model of a worker process, kept for its next tasks."""
    return Model(path)


def slices(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of SLICE_CHARS characters together, or one text."""
    a = size = 0
    for b, text in enumerate(texts):
        if b > a and size + len(text) > SLICE_CHARS:
            yield a, b
            a, size = b, 0
        size += len(text)
    if a < len(texts):
        yield a, len(texts)


def _columns(docs: DataFrame, *more: tuple[str, T.DataType]) -> tuple[T.StructType, pa.Schema]:
    """Spark's and Arrow's schema of doc_id and more columns."""
    fields = [("doc_id", docs.schema["doc_id"].dataType), *more]
    return T.StructType([T.StructField(*f) for f in fields]), pa.schema([(n, to_arrow_type(k)) for n, k in fields])


def encode(docs: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id and ids (array of int) of every text."""
    path = model or model_path()
    schema, arrow = _columns(docs, ("ids", T.ArrayType(T.IntegerType())))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model_of(path)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in slices(texts):
                ids = own.encode(texts[a:b])
                ends = np.cumsum([0, *map(len, ids)])
                lists = pa.LargeListArray.from_arrays(ends, np.concatenate(ids)).cast(arrow.field(1).type)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a).cast(arrow.field(0).type), lists], schema=arrow)

    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(task, schema)


def decode(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id and text of every row's ids."""
    path = model or model_path()
    schema, arrow = _columns(encoded, ("text", T.StringType()))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model_of(path)
        for batch in batches:
            texts = [own.decode(ids or []) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(arrow.field(0).type), pa.array(texts, pa.string())], schema=arrow)

    return encoded.select("doc_id", "ids").mapInArrow(task, schema)


def round_trip(docs: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256: every text encoded and its ids decoded in one pass, so that ids are not carried about."""
    path = model or model_path()
    schema, arrow = _columns(docs, ("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType()))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model_of(path)
        shown = [str(i) for i in range(own.size)]
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in slices(texts):
                ids = [x.tolist() for x in own.encode(texts[a:b])]
                listed = [hashlib.sha256(",".join(map(shown.__getitem__, x)).encode()).hexdigest() for x in ids]
                decoded = [hashlib.sha256(own.decode(x).encode("utf-8", "surrogatepass")).hexdigest() for x in ids]
                columns = [batch.column("doc_id").slice(a, b - a).cast(arrow.field(0).type), pa.array(map(len, ids), pa.int64()), pa.array(listed), pa.array(decoded)]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(task, schema)


def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"))
