"""SentencePiece encoding and decoding by vectorised merge rounds.

The words of a run of texts that a worker hasn't met lie in one flat numpy array of symbols. A round looks up the
rank of every adjacent pair, takes the smallest rank of each word (a segmented minimum), merges all leftmost pairs
of that rank at once, and compacts the array, until no word has a pair left. No piece of such a vocabulary has a
space mark after another character, so texts fall into words there and a word's pieces depend on it alone.

Merging all pairs of a rank at once equals merging one after the other unless the new piece could at once take
part in a merge that is due earlier or at the same time. Such pieces are found when the vocabulary is read, and of them only
the leftmost pair of a word is merged in a round.

A round over a word costs its length, so the words of more than LONG characters (unspaced scripts, base64) have rounds of their
own, over linked symbols: the places of each rank are kept, and a round takes those of the least rank alone.

Decoding goes from ids to the bytes of their pieces, which a worker keeps for each sequence of ids that it has met.

Defined results
  null or empty text: no ids, an empty decoded text.
  characters outside the vocabulary: their bytes' pieces, or the unknown piece where the vocabulary has no bytes.
  very long texts and words: whole; the work grows nearly in proportion to their length.
  ties of rank go to the leftmost pair, as in the library. Null ids and ids of any type are kept as they are.
  repeated rows: one result row each; an empty table gives an empty result; the columns besides the id and the text are not
  read, whatever their names.
  a vocabulary with another normalisation than none, without the space put in front, or with pieces that have a space mark
  after another character raises ValueError.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.llm.common import slices, table

SPACE = "▁"
_WORDS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
_NONE = np.iinfo(np.int32).max
#: Words whose pieces a worker keeps; at this number it starts afresh. Longer words aren't kept.
KEPT_WORDS, KEPT_LENGTH = 250_000, 48
#: Longer words have rounds of their own.
LONG = 512
#: Texts that tell whether the library treats a vocabulary's texts as this module does.
PROBES = [" two  spaces ", "\u00a0wide\u3000space", "ﬁ½Ａ①", "e\u0301 é", "tab\tline\r\n", "\u200bzero\x00", "▁mark ▁ ▁", "Straße ČÁ"]


class PieceCodec:
    """Encodes and decodes with one BPE vocabulary file of the sentencepiece library, which only reads the file."""

    def __init__(self, content: bytes):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_proto=content)
        size = model.get_piece_size()
        pieces = [model.id_to_piece(i) for i in range(size)]
        plain = [i for i in range(size) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.unknown = model.unk_id()
        byte_ids = {int(pieces[i][3:5], 16): i for i in range(size) if model.is_byte(i)}
        self.byte_ids = [byte_ids.get(b, self.unknown) for b in range(256)] if byte_ids else None
        ids = {pieces[i]: i for i in plain}
        self.surface = [b"" if model.is_control(i) else b" \xe2\x81\x87 " if model.is_unknown(i) else bytes([int(x[3:5], 16)]) if model.is_byte(i) else x.replace(SPACE, " ").encode() for i, x in enumerate(pieces)]
        # symbols: pieces by their id, then characters that are no piece by themselves but part of one
        symbols = dict(ids)
        for x in ids:
            for c in x:
                symbols.setdefault(c, size + len(symbols))
        self.size = size
        singles = sorted((ord(x), i) for x, i in symbols.items() if len(x) == 1)
        self.code_points = np.array([c for c, _ in singles], np.int64)
        self.code_symbols = np.array([i for _, i in singles], np.int32)
        # the higher a piece's score, the earlier it is merged; equal scores are due together
        rank = np.unique(-np.array([model.get_score(i) for i in plain]), return_inverse=True)[1]
        due = np.full(size + len(symbols) + 1, -1, np.int32)
        due[plain] = rank
        left, right, whole = [], [], []
        for x, i in ids.items():
            for k in range(1, len(x)):
                if (a := symbols.get(x[:k])) is not None and (b := symbols.get(x[k:])) is not None:
                    left.append(a)
                    right.append(b)
                    whole.append(i)
        self.base = np.int64(size + len(symbols) + 1)
        key = np.array(left, np.int64) * self.base + np.array(right, np.int64)
        order = np.argsort(key)
        self.keys, self.whole = key[order], np.array(whole, np.int32)[order]
        self.rank = due[self.whole]
        self.single_step = np.zeros(len(due), bool)
        for part in (np.array(left), np.array(right)):
            early = due[part] >= due[np.array(whole)]
            self.single_step[part[early & (due[part] >= 0)]] = True
        self.kept: dict[str, str] = {}
        self.bytes_of: dict[str, bytes] = {}
        inner = [x for x in ids if SPACE in x.lstrip(SPACE)]
        if inner or any(self.encode(x) != model.encode(x) or self.decode(self.encode(x)) != model.decode(model.encode(x)) for x in PROBES):
            raise ValueError("this vocabulary normalises texts, or cuts them into words, in a way that isn't carried over")

    def _pairs(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged symbol of each pair; _NONE where there is no such piece."""
        key = a.astype(np.int64) * self.base + b
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        hit = (self.keys[at] == key) & (a >= 0) & (b >= 0)
        return np.where(hit, self.rank[at], _NONE).astype(np.int32), np.where(hit, self.whole[at], -1).astype(np.int32)

    def _merge(self, sym: np.ndarray, word: np.ndarray, mark: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Merge rounds over flat arrays: symbol, its word, and where its text begins."""
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        rank = np.full(len(sym), _NONE, np.int32)
        new = np.full(len(sym), -1, np.int32)
        fresh = np.ones(len(sym), bool)  # whose pair with the next symbol is to be looked up
        while len(sym):
            inner = np.zeros(len(sym), bool)
            inner[:-1] = word[1:] == word[:-1]
            rank[~inner] = _NONE
            look = np.flatnonzero(fresh & inner)
            rank[look], new[look] = self._pairs(sym[look], sym[look + 1])
            start = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            length = np.diff(np.r_[start, len(sym)])
            least = np.minimum.reduceat(rank, start)
            over = np.repeat(least == _NONE, length)
            if over.any():
                done.append((sym[over], word[over], mark[over]))
                keep = ~over
                sym, word, mark, rank, new = sym[keep], word[keep], mark[keep], rank[keep], new[keep]
                if not len(sym):
                    break
                start = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
                length = np.diff(np.r_[start, len(sym)])
                least = least[least != _NONE]
            at = np.flatnonzero(rank == np.repeat(least, length))
            first = np.r_[True, word[at[1:]] != word[at[:-1]]]
            lead = np.repeat(self.single_step[new[at[first]]], np.diff(np.r_[np.flatnonzero(first), len(at)]))
            run = np.r_[True, np.diff(at) != 1]
            begin = np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
            at = at[((np.arange(len(at)) - begin) % 2 == 0) & (~lead | first)]
            sym[at] = new[at]
            gone = np.zeros(len(sym), bool)
            gone[at + 1] = True
            fresh = np.zeros(len(sym), bool)
            fresh[at] = True
            before = np.r_[False, ~gone[:-1]]
            # the symbol before a merged one: one place to the left, or two where that one has just gone
            fresh[np.where(before[at], at - 1, at - 2)[at > 0]] = True
            keep = ~gone
            sym, word, mark, rank, new, fresh = sym[keep], word[keep], mark[keep], rank[keep], new[keep], fresh[keep]
        if not done:
            return sym, word, mark
        sym, word, mark = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.lexsort((mark, word))
        return sym[order], word[order], mark[order]

    def _merge_linked(self, sym: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As _merge, for long words: rounds over linked symbols, each of which looks at the places of one rank alone."""
        n = len(sym)
        after = np.where(np.r_[word[1:] == word[:-1], False], np.arange(1, n + 1), -1)
        before = np.where(np.r_[False, word[1:] == word[:-1]], np.arange(-1, n - 1), -1)
        rank, new = np.full(n, _NONE, np.int32), np.full(n, -1, np.int32)
        due: list[int] = []
        places: dict[int, list[np.ndarray]] = {}

        def look(at: np.ndarray) -> None:
            rank[at] = _NONE
            at = at[after[at] >= 0]
            rank[at], new[at] = self._pairs(sym[at], sym[after[at]])
            at = at[rank[at] != _NONE]
            if not len(at):
                return
            at = at[np.argsort(rank[at], kind="stable")]
            cuts = np.flatnonzero(np.diff(rank[at])) + 1
            for some in np.split(at, cuts):
                r = int(rank[some[0]])
                if r not in places:
                    heapq.heappush(due, r)
                places.setdefault(r, []).append(some)

        look(np.arange(n))
        while due:
            r = heapq.heappop(due)
            at = np.unique(np.concatenate(places.pop(r)))
            at = at[rank[at] == r]
            if not len(at):
                continue
            # of pairs that overlap every other one, from the left
            run = np.r_[True, after[at[:-1]] != at[1:]]
            begin = np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
            every, at = at, at[(np.arange(len(at)) - begin) % 2 == 0]
            if (single := self.single_step[new[at]]).any():
                # where the new piece has a pair that is due at once, what lies beyond in the word has to wait
                left, right = before[at], after[after[at]]
                piece = new[at]
                early = (left >= 0) & (self._pairs(sym[left], piece)[0] <= r) | (right >= 0) & (self._pairs(piece, sym[right])[0] <= r)
                early[1:] |= (at[1:] == right[:-1]) & (self._pairs(piece[:-1], piece[1:])[0] <= r)
                early &= single
                if early.any():
                    waits = np.cumsum(early) - early
                    head = np.r_[True, word[at[1:]] != word[at[:-1]]]
                    at = at[waits == np.maximum.accumulate(np.where(head, waits, 0))]
                    if len(rest := np.setdiff1d(every, at, assume_unique=True)):
                        heapq.heappush(due, r)
                        places[r] = [rest]
            gone = after[at]
            sym[at], rank[gone] = new[at], _NONE
            after[at] = after[gone]
            follow = after[at] >= 0
            before[after[at[follow]]] = at[follow]
            after[gone] = -2
            left = before[at]
            look(np.unique(np.concatenate([at, left[left >= 0]])))
        alive = np.flatnonzero(after != -2)
        return sym[alive], word[alive], alive

    def encode_words(self, words: Sequence[str]) -> list[list[int]]:
        """The ids of each word; a word is a run of space marks, then other characters."""
        if not words:
            return []
        code = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        length = np.array([len(w) for w in words])
        word = np.repeat(np.arange(len(words), dtype=np.int32), length)
        at = np.searchsorted(self.code_points, code)
        at[at == len(self.code_points)] = 0
        sym = np.where(self.code_points[at] == code, self.code_symbols[at], -1).astype(np.int32)
        long = (length > LONG)[word]
        places = np.flatnonzero(~long)
        sym_short, word_short, mark_short = self._merge(sym[~long], word[~long], places)
        if long.any():
            places = np.flatnonzero(long)
            sym_long, word_long, mark_long = self._merge_linked(sym[long], word[long])
            sym, word, mark = np.r_[sym_short, sym_long], np.r_[word_short, word_long], np.r_[mark_short, places[mark_long]]
        else:
            sym, word, mark = sym_short, word_short, mark_short
        out: list[list[int]] = [[] for _ in words]
        for s, w, m in zip(sym.tolist(), word.tolist(), mark.tolist(), strict=True):
            if 0 <= s < self.size:
                out[w].append(s)
            elif self.byte_ids:
                out[w] += [self.byte_ids[b] for b in chr(code[m]).encode("utf-8", "surrogatepass")]
            else:
                out[w].append(self.unknown)
        return out

    def learn(self, words: Sequence[str]) -> tuple[dict[str, str], dict[str, bytes]]:
        """The ids, in decimal, of words that aren't kept, and the bytes that those ids stand for; keeps them."""
        found, back = {}, {}
        for w, ids in zip(words, self.encode_words(words), strict=True):
            found[w] = text = ",".join(map(str, ids))
            if text not in self.bytes_of and text not in back:
                back[text] = b"".join([self.surface[i] for i in ids])
        if len(self.kept) + len(found) > KEPT_WORDS:
            self.kept.clear()
            self.bytes_of.clear()
            back = {text: b"".join([self.surface[int(i)] for i in text.split(",")]) for text in found.values()}
        for w, text in found.items():
            if len(w) <= KEPT_LENGTH:
                self.kept[w] = text
                if text in back:
                    self.bytes_of[text] = back[text]
        return found, back

    def split(self, text: str | None) -> list[str]:
        return _WORDS.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def encode(self, text: str | None) -> list[int]:
        return [i for ids in self.encode_words(self.split(text)) for i in ids]

    def decode(self, ids: Sequence[int]) -> str:
        return self.decoded(b"".join([self.surface[i] for i in ids]))

    @staticmethod
    def decoded(surface: bytes) -> str:
        """The text of joined surfaces, without the space that encoding puts in front."""
        return surface.removeprefix(b" ").decode("utf-8", "replace")

    def digests(self, texts: list[str | None]) -> Iterator[tuple[int, str, str]]:
        split = [self.split(x) for x in texts]
        every = {w for words in split for w in words}
        learnt, back = self.learn(list(every - self.kept.keys()))
        if gone := every - self.kept.keys() - learnt.keys():  # started afresh
            more, others = self.learn(list(gone))
            learnt, back = learnt | more, back | others
        kept, bytes_of = self.kept, self.bytes_of
        for words in split:
            parts = [kept.get(w) or learnt[w] for w in words]
            ids = ",".join(parts)
            decoded = self.decoded(b"".join([bytes_of.get(x) or back[x] for x in parts]))
            yield ids.count(",") + 1 if words else 0, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode("utf-8", "replace")).hexdigest()


@lru_cache(maxsize=2)
def _codec(content: bytes) -> PieceCodec:
    return PieceCodec(content)


def _shared(df: DataFrame, vocabulary: str):
    with open(vocabulary, "rb") as file:
        return df.sparkSession.sparkContext.broadcast(file.read())


def encode_texts(docs: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids) for every row. vocabulary: path of the file on the driver; its content, half a MB for any
    input, is broadcast. One pass, no shuffle."""
    shared = _shared(docs, vocabulary)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared.value)
        for batch in batches:
            for a, b, texts in slices(batch.column(1)):
                split = [codec.split(x) for x in texts]
                words = list({w for s in split for w in s})
                ids = dict(zip(words, codec.encode_words(words), strict=True))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([[i for w in s for i in ids[w]] for s in split], pa.list_(pa.int32()))], ["id", "ids"])

    read = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return read.mapInArrow(encode, f"id {read.schema['id'].dataType.simpleString()}, ids array<int>").withColumnRenamed("id", id_col)


def decode_ids(encoded: DataFrame, vocabulary: str, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) for every row; null ids give an empty text."""
    shared = _shared(encoded, vocabulary)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([codec.decode(x.as_py() or []) for x in batch.column(1)], pa.string())], ["id", "text"])

    read = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    return read.mapInArrow(decode, f"id {read.schema['id'].dataType.simpleString()}, text string").withColumnRenamed("id", id_col)


def piece_digests(docs: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of encoding and decoding every row, without moving the ids out of the task."""
    shared = _shared(docs, vocabulary)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared.value)
        for batch in batches:
            for a, b, texts in slices(batch.column(1)):
                n, ids, text = zip(*codec.digests(texts), strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(n, pa.int64()), pa.array(ids), pa.array(text)], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    read = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = read.schema["id"].dataType.simpleString()
    return read.mapInArrow(digest, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return piece_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {"op4_sentencepiece": op4_sentencepiece}
SQL: dict[str, str] = {}
