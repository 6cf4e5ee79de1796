"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

The model file gives pieces, scores and kinds; encoding and decoding are done
here. A text is normalised (identity, a space before it, spaces as U+2581) and
cut where U+2581 follows another character: no piece goes across such a place,
so words merge apart from each other, and each distinct word is encoded once a
batch. All words' symbols stand in one flat array. In each round every word
finds the least rank among its neighbouring pairs; its leftmost occurrences of
that rank merge at once, and merged arrays are compacted. Where a merge makes a
pair of the same or a lower rank, only the leftmost one is done, as the
sequential order would take the new pair first.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
_WORDS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
#: Distinct words kept from batch to batch, and characters encoded at once.
CACHE, AT_ONCE = 200_000, 400_000
#: Characters of texts whose words are looked up together.
TOGETHER = 1_000_000
_NONE = np.int64(2**62)


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a message in the protocol buffers' wire format."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = number()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, number()
            continue
        size = number() if kind == 2 else 8 if kind == 1 else 4
        yield tag >> 3, data[at : at + size]
        at += size


def check(proto: bytes) -> None:
    """ValueError unless a serialised model is of the kind that is encoded here.

    That is BPE, with byte fallback, without a normalisation table, with a space
    put in front, white space kept and spaces as U+2581, and no pieces of the user's.
    """
    # Numbers of the fields, and what they are where a file leaves them out.
    trainer, normalizer = {3: 1, 35: 0, 24: 0}, {2: b"", 3: 1, 4: 1, 5: 1}
    kinds = set()
    for field, value in _fields(proto):
        if field == 1:
            kinds.add(dict(_fields(value)).get(3, 1))
        elif field == 2:
            trainer |= dict(_fields(value))
        elif field == 3:
            normalizer |= dict(_fields(value))
    wrong = {
        "it is no BPE model": trainer[3] != 2,
        "it has no byte fallback": not trainer[35],
        "it puts the space mark behind words": bool(trainer[24]),
        "it has a normalisation table": bool(normalizer[2]),
        "it puts no space in front": not normalizer[3],
        "it removes white space": bool(normalizer[4]),
        "it leaves spaces as they are": not normalizer[5],
        "it has pieces defined by its user": 4 in kinds,
    }
    if any(wrong.values()):
        raise ValueError("the model cannot be used: " + ", ".join(k for k, v in wrong.items() if v))


class Model:
    """Tables from a SentencePiece BPE model file with byte fallback and identity normalisation."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        source = sentencepiece.SentencePieceProcessor(model_file=path)
        check(source.serialized_model_proto())
        n = source.vocab_size()
        self.end = source.eos_id()
        pieces = [source.id_to_piece(i) for i in range(n)]
        special = [source.is_control(i) or source.is_unknown(i) for i in range(n)]
        self.bytes = {int(pieces[i][3:5], 16): i for i in range(n) if source.is_byte(i)}
        normal = {pieces[i]: i for i in range(n) if not special[i] and not source.is_byte(i)}
        if len(self.bytes) != 256 or any(SPACE in p.lstrip(SPACE) for p in normal):
            raise ValueError("the model needs byte fallback and pieces that hold a space mark only in front")
        symbols = dict(normal)  # single characters of pieces may be missing among the pieces
        for c in sorted({c for p in normal for c in p} - set(normal)):
            symbols[c] = n + len(symbols)
        self.size = max(symbols.values()) + 1
        order = {s: k for k, s in enumerate(sorted({-source.get_score(i) for i in normal.values()}))}
        keys, ranks, made = [], [], []
        for p, i in normal.items():
            for k in range(1, len(p)):
                if p[:k] in symbols and p[k:] in symbols:
                    keys.append(symbols[p[:k]] * self.size + symbols[p[k:]])
                    ranks.append(order[-source.get_score(i)])
                    made.append(i)
        sort = np.argsort(keys)
        self.keys, self.ranks, self.made = (np.array(x, np.int64)[sort] for x in (keys, ranks, made))
        self.symbols = {c: i for c, i in symbols.items() if len(c) == 1}
        self.outside = {i: c for c, i in self.symbols.items() if i >= n}
        self.byte_ids = np.array([self.bytes[i] for i in range(256)], np.int64)
        self.decimal = [str(i) for i in range(n)]
        self.pieces = n
        self.surface = [b"" if special[i] else bytes([int(pieces[i][3:5], 16)]) if source.is_byte(i) else pieces[i].replace(SPACE, " ").encode() for i in range(n)]
        self.digits = np.array([len(x) + 1 for x in self.decimal], np.int64)  # with the space behind
        self.sizes = np.array([len(x) for x in self.surface], np.int64)
        self.unknown = source.unk_id()
        self.is_byte = np.array([source.is_byte(i) for i in range(n)])

    def pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged symbol of each pair; a pair that merges to no piece has the rank _NONE."""
        key = np.where((left >= 0) & (right >= 0), left * self.size + right, -1)
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        hit = self.keys[at] == key
        return np.where(hit, self.ranks[at], _NONE), self.made[at]


@lru_cache(maxsize=2)
def load(path: str) -> Model:
    return Model(path)


def merge_rounds(model: Model, symbols: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merge the symbols of all words to the end; word: non-decreasing word numbers, one for each symbol.

    Symbols below 0 merge with nothing. Returns symbols and words after the last round.
    """
    done_s, done_w = [], []
    rank, made = model.pairs(symbols, np.append(symbols[1:], -1))
    rank[np.append(word[1:] != word[:-1], True)] = _NONE
    while len(symbols):
        first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        length = np.diff(np.append(first, len(symbols)))
        lowest = np.minimum.reduceat(rank, first)
        over = lowest == _NONE
        if over.any():  # words without a pair leave the arrays
            keep = ~np.repeat(over, length)
            done_s.append(symbols[~keep])
            done_w.append(word[~keep])
            symbols, word, rank, made = symbols[keep], word[keep], rank[keep], made[keep]
            if not len(symbols):
                break
            lowest, length = lowest[~over], length[~over]
        at = np.flatnonzero(rank == np.repeat(lowest, length))
        # Of touching occurrences every second one merges, from the left.
        begins = np.append(True, np.diff(at) != 1)
        origin = np.maximum.accumulate(np.where(begins, np.arange(len(at)), 0))
        at = at[(np.arange(len(at)) - origin) % 2 == 0]
        trial = _merged(model, symbols, word, rank, made, at)
        early = trial[4] <= rank[at]
        if early.any():
            hasty = np.zeros(int(word[-1]) + 1, bool)
            hasty[word[at[early]]] = True
            leading = np.append(True, word[at[1:]] != word[at[:-1]])
            trial = _merged(model, symbols, word, rank, made, at[leading | ~hasty[word[at]]])
        symbols, word, rank, made, _ = trial
    if not done_s:
        return symbols, word
    symbols, word = np.concatenate(done_s), np.concatenate(done_w)
    order = np.argsort(word, kind="stable")
    return symbols[order], word[order]


def _merged(model: Model, symbols: np.ndarray, word: np.ndarray, rank: np.ndarray, made: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """Arrays after the pairs at `at` have merged, and the least rank of the pairs that each merged symbol is in."""
    keep = np.ones(len(symbols), bool)
    keep[at + 1] = False
    new = symbols.copy()
    new[at] = made[at]
    new, words, ranks, makes = new[keep], word[keep], rank[keep], made[keep]
    place = at - np.arange(len(at))  # each earlier merge took one symbol away
    left = place[(place > 0) & (words[place - 1] == words[place])] - 1
    right = place[place + 1 < len(new)]
    right = right[words[right + 1] == words[right]]
    ranks[place] = _NONE
    changed = np.concatenate([left, right])
    ranks[changed], makes[changed] = model.pairs(new[changed], new[changed + 1])
    before = np.where((place > 0) & (words[place - 1] == words[place]), ranks[place - 1], _NONE)
    return new, words, ranks, makes, np.minimum(before, ranks[place])


def encode_flat(model: Model, words: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first word, ids, ends) for parts of the words, which are as _WORDS cuts them: ids of all words of the part, and where each word's end."""
    low = 0
    while low < len(words):
        high, size = low, 0
        while high < len(words) and (high == low or size + len(words[high]) <= AT_ONCE):
            size += len(words[high])
            high += 1
        part = words[low:high]
        characters = np.frombuffer("".join(part).encode("utf-32-le"), np.uint32)
        distinct, code = np.unique(characters, return_inverse=True)
        known = np.array([model.symbols.get(chr(c), -1 - int(c)) for c in distinct], np.int64)
        word = np.repeat(np.arange(len(part)), [len(w) for w in part])
        symbols, word = merge_rounds(model, known[code], word)
        odd = np.flatnonzero((symbols < 0) | (symbols >= model.pieces))
        if len(odd):  # characters without a piece become their bytes
            raw = [(chr(-1 - s) if s < 0 else model.outside[s]).encode() for s in symbols[odd].tolist()]
            times = np.ones(len(symbols), np.int64)
            times[odd] = [len(x) for x in raw]
            bytes_ = np.repeat(np.isin(np.arange(len(symbols)), odd, assume_unique=True), times)
            symbols, word = np.repeat(symbols, times), np.repeat(word, times)
            symbols[bytes_] = model.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
        yield low, symbols, np.searchsorted(word, np.arange(1, len(part) + 1))
        low = high


def encode_words(model: Model, words: list[str]) -> list[list[int]]:
    """Ids of each word."""
    out: list[list[int]] = []
    for _, ids, ends in encode_flat(model, words):
        flat, at = ids.tolist(), [0, *ends.tolist()]
        out += [flat[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
    return out


def decode(model: Model, ids: list[int]) -> str:
    """The text of ids: pieces joined, the space before the first word dropped, bytes that are no UTF-8 as U+FFFD each."""
    parts: list[str] = []
    raw = bytearray()

    def flush() -> None:
        left = bytes(raw)
        raw.clear()
        while left:
            try:
                parts.append(left.decode())
                return
            except UnicodeDecodeError as e:
                parts.append(left[: e.start].decode() + "�")
                left = left[e.start + 1 :]

    leading = True
    for i in ids:
        if model.is_byte[i]:
            raw += model.surface[i]
            leading = False
            continue
        flush()
        text = " ⁇ " if i == model.unknown else model.surface[i].decode()
        if leading and text:
            text = text[1:] if text[0] == " " else text
            leading = False
        parts.append(text)
    flush()
    return "".join(parts)


class Encoder:
    """Encodes texts; keeps the words of earlier batches that came more than once."""

    def __init__(self, path: str) -> None:
        self.model = load(path)
        self.numbers: dict[str, str] = {}  # a word's decimal ids
        self.decoded: dict[str, str] = {}
        self.common: set[str] = set()

    def learn(self, words: set[str]) -> None:
        self.common |= words & self.numbers.keys()
        if len(self.numbers) > CACHE:  # words that have come once are encoded again if they are wanted
            kept = self.common if len(self.common) <= CACHE // 2 else set()
            self.numbers, self.decoded, self.common = {w: self.numbers[w] for w in kept}, {w: self.decoded[w] for w in kept}, set()
        new = list(words - self.numbers.keys())
        surface, decimal = self.model.surface, self.model.decimal
        for low, ids, ends in encode_flat(self.model, new):
            # The strings of all words stand in one; each word's is cut from it.
            flat = ids.tolist()
            number, text = " ".join([decimal[i] for i in flat]), b"".join([surface[i] for i in flat])
            digits, sizes = (np.concatenate([[0], np.cumsum(table[ids])])[np.concatenate([[0], ends])].tolist() for table in (self.model.digits, self.model.sizes))
            for k, w in enumerate(new[low : low + len(ends)]):
                self.numbers[w] = number[digits[k] : digits[k + 1] - 1]
                # Words' bytes are valid text, as fallback bytes come from whole characters.
                self.decoded[w] = text[sizes[k] : sizes[k + 1]].decode()

    def digests(self, texts: list[str]) -> Iterator[tuple[int, str, str]]:
        """(ids, SHA-256 of the decimal ids joined by spaces, SHA-256 of the decoded text) of each text."""
        low, decimal = 0, str(self.model.end)
        while low < len(texts):
            high, size = low, 0
            while high < len(texts) and (high == low or size + len(texts[high]) <= TOGETHER):
                size += len(texts[high])
                high += 1
            cut = [_WORDS.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts[low:high]]
            self.learn({w for words in cut for w in words})
            for words in cut:
                ids = " ".join([*map(self.numbers.__getitem__, words), decimal])
                decoded = "".join(map(self.decoded.__getitem__, words))[1:]
                yield ids.count(" ") + 1, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()
            low = high

    def ids(self, text: str) -> list[int]:
        words = _WORDS.findall(SPACE + text.replace(" ", SPACE)) if text else []
        self.learn(set(words))
        return [*(int(i) for w in words for i in self.numbers[w].split(" ")), self.model.end]


def encode(docs: DataFrame, model_path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """docs with the ids (array<int>, an end id last) of each whole text; null is the empty text. A column of that name is replaced.

    model_path must be readable at the same place on every executor.
    """
    kept = docs.drop(ids_col)

    def ids(texts: Iterator) -> Iterator:
        import pandas as pd

        own = Encoder(model_path)
        for t in texts:
            yield pd.Series([np.array(own.ids(x or ""), np.int32) for x in t])

    ids_ = F.pandas_udf(ids, "array<int>", F.PandasUDFType.SCALAR_ITER)
    return kept.withColumn(ids_col, ids_(F.col(text_col)))


def token_digests(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens long, ids_sha256, decoded_sha256) for each row, as Encoder.digests gives them.

    Null is the empty text, which has the end id only. Repeated and null ids are
    rows as any others; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Encoder(model_path)
        for b in batches:
            got = list(own.digests([x or "" for x in b[1].to_pylist()]))
            yield pa.RecordBatch.from_arrays([b[0], *(pa.array([g[i] for g in got], k) for i, k in enumerate((pa.int64(), pa.string(), pa.string())))], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    found = docs.select(F.col(id_col).alias("id"), F.col(text_col)).mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return found.withColumnRenamed("id", id_col)
