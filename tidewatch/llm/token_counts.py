"""Token counts of a byte-pair vocabulary, without the tokens.

A word is a linked list of symbols, at first its characters. A heap holds the adjacent pairs that join to a piece, by rank
(the better score first) and place; the lowest is taken out and joined until none is left. A word then has as many tokens
as it had symbols at first, less one for each join; a character that is no piece counts its bytes instead.

A text is cut into words where no piece can reach across. Counts of words are kept by the Python worker; a kept count
that is forgotten is worked out again.

* null and empty texts have no token
* a text of any length is counted whole; a word of over ``LONG`` characters is cut further, between two characters that
  stand side by side in no piece
* repeated rows are counted one by one; extra columns are kept, and one of a result's name is replaced
"""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
import hashlib
from heapq import heapify, heappop, heappush
from itertools import islice
import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

MARK = "▁"
_WORD = re.compile(r" *[^ ]+| +")
#: Characters of a word beyond which it is cut between characters that no piece joins.
LONG = 4_096
#: Different words whose counts a Python worker keeps; all are forgotten beyond that.
KEEP_WORDS = 1_000_000


@dataclass(frozen=True)
class MergeRanks:
    """Rank of every piece (equal scores share one), the mark as a space; whether spaces end words and bytes stand in for
    unknown characters; what the library puts in front of a text."""

    rank: dict[str, int]
    byte_fallback: bool
    prefix: str
    longest: int = field(init=False)
    words_end: bool = field(init=False)
    joined: frozenset[str] = field(init=False)
    digest: str = field(init=False)

    def __post_init__(self) -> None:
        put = lambda name, value: object.__setattr__(self, name, value)
        put("longest", max(map(len, self.rank), default=0))
        put("words_end", not any(re.search("[^ ] ", p) for p in self.rank))
        put("joined", frozenset(p[i:i + 2] for p in self.rank for i in range(len(p) - 1)))
        put("digest", hashlib.sha256(repr((sorted(self.rank.items()), self.byte_fallback, self.prefix)).encode()).hexdigest())


def load(path: str) -> MergeRanks:
    """Ranks of a ``.model`` file of byte-pair type that leaves texts as they are but for a space in front."""
    from sentencepiece import sentencepiece_model_pb2 as model

    with open(path, "rb") as f:
        m = model.ModelProto.FromString(f.read())
    spec = m.normalizer_spec
    if (m.trainer_spec.model_type != model.TrainerSpec.BPE or spec.precompiled_charsmap or spec.remove_extra_whitespaces
            or not spec.escape_whitespaces or m.trainer_spec.treat_whitespace_as_suffix
            or any(p.type in (model.ModelProto.SentencePiece.USER_DEFINED, model.ModelProto.SentencePiece.UNUSED) for p in m.pieces)):
        raise ValueError(f"{path}: only byte-pair models without normalisation, user-defined and unused pieces are supported")
    normal = [p for p in m.pieces if p.type == model.ModelProto.SentencePiece.NORMAL]
    place = {s: i for i, s in enumerate(sorted({p.score for p in normal}, reverse=True))}
    return MergeRanks({p.piece.replace(MARK, " "): place[p.score] for p in normal}, m.trainer_spec.byte_fallback,
                      " " if spec.add_dummy_prefix else "")


def public_ranks() -> MergeRanks:
    import public_tokenizers
    return load(public_tokenizers.path("piece_bpe_32k.model"))


def count_word(word: str, ranks: MergeRanks) -> int:
    """Tokens of one word: its characters, less the joins, plus the further bytes of characters without a piece."""
    rank, longest, n = ranks.rank, ranks.longest, len(word)
    size = array("i", [1]) * n                        # characters of the symbol that begins here; 0 if it was joined to another
    before, after = array("i", range(-1, n - 1)), array("i", range(1, n + 1))
    # rank × n + place sorts as (rank, place). An entry is out of date if the symbols now at its place have another rank.
    heap = [r * n + i for i in range(n - 1) if (r := rank.get(word[i:i + 2])) is not None]
    heapify(heap)
    merges = 0

    def offer(i: int, end: int) -> None:
        if end - i <= longest and (r := rank.get(word[i:end])) is not None:
            heappush(heap, r * n + i)

    while heap:
        r, i = divmod(heappop(heap), n)
        j = after[i]
        if not size[i] or j >= n:
            continue
        end = j + size[j]
        if rank.get(word[i:end]) != r:
            continue
        size[i], size[j], after[i] = end - i, 0, end
        merges += 1
        if end < n:
            before[end] = i
            offer(i, end + size[end])
        if before[i] >= 0:
            offer(before[i], end)
    total = n - merges
    if ranks.byte_fallback:
        i = 0
        while i < n:
            if size[i] == 1 and word[i] not in rank:
                total += len(word[i].encode()) - 1
            i = after[i]
    elif n:                                           # the library gives one unknown token for a run of unknown characters
        i, known = 0, True
        while i < n:
            odd = size[i] == 1 and word[i] not in rank
            total -= odd and not known
            i, known = after[i], not odd
    return total


def cut(word: str, ranks: MergeRanks) -> Iterator[str]:
    """Parts of a long word; no piece holds the two characters on either side of a cut."""
    start = 0
    for i in range(1, len(word)):
        if word[i - 1:i + 1] not in ranks.joined:
            yield word[start:i]
            start = i
    yield word[start:]


_KNOWN: dict[str, dict[str, int]] = {}


def counter(ranks: MergeRanks) -> Callable[[str | None], int]:
    """A function that counts the tokens of a text."""
    known = _KNOWN.setdefault(ranks.digest, {})

    def count_text(text: str | None) -> int:
        if not text:
            return 0
        text = ranks.prefix + text.replace(MARK, " ")
        if not (ranks.words_end and ranks.byte_fallback):
            return count_word(text, ranks)
        if len(text) <= 1 << 20:
            return add(_WORD.findall(text))
        words, total = (m.group() for m in _WORD.finditer(text)), 0
        while some := list(islice(words, 100_000)):
            total += add(some)
        return total

    def add(words: list[str]) -> int:
        counts = list(map(known.get, words))
        if None in counts:
            for i, n in enumerate(counts):
                if n is None:
                    w = words[i]
                    if len(w) > LONG:
                        counts[i] = sum(count_word(p, ranks) for p in cut(w, ranks))
                    else:
                        if len(known) >= KEEP_WORDS:
                            known.clear()
                        counts[i] = known[w] = count_word(w, ranks)
        return sum(counts)

    return count_text


def count_tokens(docs: DataFrame, ranks: MergeRanks, text: str = "text", limit: int = 4_096) -> DataFrame:
    """All columns of ``docs`` and ``n_bytes``, ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens)."""
    held = docs.sparkSession.sparkContext.broadcast(ranks)        # its size is that of the vocabulary

    @F.arrow_udf("bigint")
    def tokens(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        count_text = counter(held.value)
        for texts in batches:
            yield pa.array([count_text(t.as_py()) for t in texts], pa.int64())

    return (docs.withColumn("n_tokens", tokens(F.col(text)))
            .withColumn("n_bytes", F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("bigint"))
            .withColumn("over_limit", F.col("n_tokens") > limit))
