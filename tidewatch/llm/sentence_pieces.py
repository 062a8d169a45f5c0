"""SentencePiece encoding and decoding by shared-prefix Viterbi.

A text is cut into marked words (a run of spaces and the characters up to the next space; one space is put in front of
the text). The distinct words of a task are sorted, which is a depth-first walk of their trie: forward scores and the
matches still open are kept per depth, so a word only pays for the characters it does not share with the word before it.
No piece crosses a word border, so the best paths of the words make the best path of the text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidewatch.llm.common import flat, list_array

MARK = "▁"
_WORD = re.compile(r" *[^ ]+| +")
#: Distinct words whose pieces a task keeps between batches; the walk starts anew beyond that.
KEEP_WORDS = 150_000


@dataclass(frozen=True)
class Vocabulary:
    """Piece texts with the mark as a space, in order of ids (None for control, unknown and byte pieces), scores, and byte ids."""

    pieces: list
    scores: list
    byte_ids: list
    unknown: int

    @property
    def as_bytes(self) -> tuple[np.ndarray, np.ndarray]:
        """All pieces end to end and their offsets; control pieces are empty."""
        byte_of = {i: bytes([b]) for b, i in enumerate(self.byte_ids)}
        parts = [p.encode() if p is not None else byte_of.get(i, b"") for i, p in enumerate(self.pieces)]
        return np.frombuffer(b"".join(parts), np.uint8), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)


def load(path: str, ranked: bool = False) -> Vocabulary:
    """Vocabulary of a model file. ``ranked``: the file's scores are merge ranks, so pieces score −log(rank + 1), rank
    being the place among the normal pieces (Zipf's law); otherwise the file's own scores count."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    pieces, scores, byte_ids, rank = [None] * n, [0.0] * n, [-1] * 256, 0
    for i in range(n):
        p = sp.id_to_piece(i)
        if sp.is_byte(i):
            byte_ids[int(p[1:-1], 16)] = i
        elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
            rank += 1
            pieces[i] = p.replace(MARK, " ")
            scores[i] = -math.log(rank + 1) if ranked else sp.get_score(i)
    return Vocabulary(pieces, scores, byte_ids if min(byte_ids) >= 0 else [], sp.unk_id())


def trie(vocabulary: Vocabulary) -> tuple[dict, float]:
    """Nested dicts by character, (score, id) under None, and the score of a byte of a character without piece."""
    root: dict = {}
    for i, p in enumerate(vocabulary.pieces):
        if p:
            node = root
            for c in p:
                node = node.setdefault(c, {})
            node[None] = (vocabulary.scores[i], i)
    return root, min(vocabulary.scores, default=0.0) - 10.0


def walk(words: list[str], root: dict, byte_score: float, byte_ids: list, unknown: int) -> Iterator[list[int]]:
    """Piece ids of each of the sorted ``words``. Of equal scores the longest last piece wins."""
    score, back, piece, opened = [0.0], [0], [None], [[(0, root)]]
    before = ""
    for word in words:
        n, depth = min(len(before), len(word)), 0
        while depth < n and before[depth] == word[depth]:
            depth += 1
        del score[depth + 1:], back[depth + 1:], piece[depth + 1:], opened[depth + 1:]
        for j in range(depth, len(word)):
            c = word[j]
            size = len(c.encode())
            best, at, pid = score[j] + byte_score * size, j, -1
            live = []
            for i, node in opened[j]:
                node = node.get(c)
                if node is not None:
                    live.append((i, node))
                    end = node.get(None)
                    if end is not None:
                        s = score[i] + end[0]
                        if s > best:
                            best, at, pid = s, i, end[1]
            live.append((j + 1, root))
            score.append(best)
            back.append(at)
            piece.append(pid)
            opened.append(live)
        before = word
        ids, j = [], len(word)
        while j:
            if piece[j] >= 0:
                ids.append(piece[j])
            else:
                raw = word[j - 1].encode()
                ids += [byte_ids[b] for b in reversed(raw)] if byte_ids else [unknown]
            j = back[j]
        yield ids[::-1]


def split(text: str) -> list[str]:
    """Marked words of a text; an empty text has none."""
    if not text:
        return []
    parts = text.split(" ")
    if "" in parts:
        return _WORD.findall(" " + text)
    return [" " + p for p in parts]


class Encoder:
    """Words met so far with their pieces in one pool; one for each task."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.root, self.byte_score = trie(vocabulary)
        self.reset()

    def reset(self):
        self.place: dict[str, int] = {}
        self.pool, self.ends = [np.zeros(0, np.int32)], [np.zeros(1, np.int64)]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of all texts end to end, and the offsets of the texts."""
        if len(self.place) > KEEP_WORDS:
            self.reset()
        docs = [split(t) for t in texts]
        new = sorted({w for d in docs for w in d} - self.place.keys())
        if new:
            found, lens = [], []
            for ids in walk(new, self.root, self.byte_score, self.vocabulary.byte_ids, self.vocabulary.unknown):
                found += ids
                lens.append(len(ids))
            first = len(self.place)
            self.place.update(zip(new, range(first, first + len(new))))
            self.ends.append(self.ends[-1][-1] + np.cumsum(lens))
            self.pool.append(np.array(found, np.int32))
            self.pool, self.ends = [np.concatenate(self.pool)], [np.concatenate(self.ends)]
        pool, ends = self.pool[0], self.ends[0]
        get = self.place.__getitem__
        n_words = np.array([len(d) for d in docs], np.int64)
        code = np.fromiter((get(w) for d in docs for w in d), np.int64, int(n_words.sum()))
        return gather(pool, ends, code, n_words)


def gather(pool: np.ndarray, ends: np.ndarray, code: np.ndarray, per_row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The slices ``code`` of ``pool`` end to end, and the offsets of rows that hold ``per_row`` slices each."""
    size = ends[code + 1] - ends[code]
    to = np.concatenate([[0], np.cumsum(size)])
    out = pool[np.repeat(ends[code] - to[:-1], size) + np.arange(to[-1])]
    return out, to[np.concatenate([[0], np.cumsum(per_row)])]


def _chunks(column: pa.Array, most: int = 1 << 20) -> Iterator[pa.Array]:
    """Runs of rows of at most about ``most`` bytes."""
    _, off = flat(column)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + most, side="right")) - 1)
        yield column.slice(lo, hi - lo)
        lo = hi


def encode(df: DataFrame, vocabulary: Vocabulary, text_col: str = "text", out: str = "ids") -> DataFrame:
    """``df`` with the piece ids of each text. Null and empty texts have none. Characters without a piece become byte
    pieces (the unknown piece if the vocabulary has no bytes). A column of that name is replaced."""
    shipped = df.sparkSession.sparkContext.broadcast(vocabulary)      # one vocabulary: some ten thousand short strings

    @F.arrow_udf("array<int>")
    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = Encoder(shipped.value)
        for column in columns:
            parts = [pa.array([], pa.list_(pa.int32()))]
            for part in _chunks(column):
                ids, off = encoder.encode([t or "" for t in part.to_pylist()])
                parts.append(list_array(ids, off))
            yield pa.concat_arrays(parts)

    return df.withColumn(out, run(F.col(text_col)))


def decode(df: DataFrame, vocabulary: Vocabulary, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with the text of the piece ids: the exact text that was encoded. Null ids give an empty text; ids outside the
    vocabulary and control pieces are left out; bytes that are no UTF-8 become U+FFFD."""
    shipped = df.sparkSession.sparkContext.broadcast(vocabulary)

    @F.arrow_udf("string")
    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        pool, ends = shipped.value.as_bytes
        for column in columns:
            column = column.fill_null([]) if column.null_count else column
            parts = [pa.array([], pa.string())]
            for lo in range(0, len(column), 256):
                part = column.slice(lo, 256)
                ids, per_row = part.flatten().fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64), part.value_lengths().to_numpy(zero_copy_only=False)
                ids = np.where((ids >= 0) & (ids < len(ends) - 1), ids, 0)
                data, off = gather(pool, ends, ids, per_row)
                raw = data.tobytes()
                parts.append(pa.array([raw[a:b].decode("utf-8", "replace").removeprefix(" ") for a, b in zip(off[:-1], off[1:])], pa.string()))
            yield pa.concat_arrays(parts)

    return df.withColumn(out, run(F.col(ids_col)))


def public_vocabulary(path: str | None = None, ranked: bool = True) -> Vocabulary:
    """The installed public vocabulary, or that of the model file ``path``."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    return load(path, ranked)
