"""Token counts of a unigram tokenizer, without tokens: a count-only Viterbi search.

The tokenizer is defined by a vocabulary of (piece, score), as in a sentencepiece model file: runs of ASCII white space
become one space, spaces become U+2581 and stand before each word, each word is segmented by itself into the pieces with
the best total score, and characters that no piece covers fall back to their UTF-8 bytes. An Aho-Corasick automaton
enumerates all vocabulary matches of a word in one pass; the dynamic programme keeps, for each position, the best score
and the number of pieces on the way there, and no path. Ties go as in the ``tokenizers`` library, which extends positions
from left to right and replaces a best score only by a greater one: among equal scores the longest last piece stays.
Only as many positions back as the longest piece has characters are kept, so that a text without spaces takes no more
memory than its own. Counts of words up to LONGEST characters are kept in a cache of ``cache_words``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table
from .tokens import tokenizer_path

SPACE = "▁"
BLANKS = re.compile(r"[\t-\r ]+")
UNKNOWN_PENALTY = 10.0
LONGEST = 48


def vocabulary(path: str) -> list[tuple[str, float]]:
    """(piece, score) by id from a sentencepiece model file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


class UnigramCounter:
    def __init__(self, pieces: list[tuple[str, float]], cache_words: int = 1 << 20):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        names = {p for p, _ in pieces}
        self.longest = max(map(len, names), default=1)
        self.single = {p for p in names if len(p) == 1}
        self.bytes = all(f"<0x{b:02X}>" in names for b in range(256))
        self.unknown = min(s for _, s in pieces) - UNKNOWN_PENALTY
        self.cache: dict[str, int] = {}
        self.cache_words = cache_words

    def word(self, w: str) -> int:
        """Pieces of one word, which is not cut any further."""
        single, unknown, size = self.single, self.unknown, self.longest + 1
        score, count, open_ = [0.0] * size, [0] * size, [False] * size  # at position modulo size
        matches = self.automaton.iter(w)
        match = next(matches, None)
        for end, c in enumerate(w):
            best, start = None, 0
            while match is not None and match[0] == end:
                length, s = match[1]
                at = end + 1 - length
                s = s + score[at % size]
                if best is None or s > best or (s == best and at < start):
                    best, start = s, at
                match = next(matches, None)
            now, last = (end + 1) % size, end % size
            if c not in single and (best is None or unknown + score[last] > best):
                score[now] = unknown + score[last]
                if self.bytes:
                    count[now] = count[last] + len(c.encode())
                else:
                    count[now] = count[last] + (not open_[last])
                open_[now] = True
            else:
                score[now], count[now], open_[now] = best, count[start % size] + 1, False
        return count[len(w) % size]

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        words = BLANKS.split(text) if SPACE not in text else BLANKS.sub(" ", text).replace(SPACE, " ").split(" ")
        if not words[0]:
            words = words[1:]
        cache, long = self.cache, {}
        missing = set(words).difference(cache)
        if missing:
            if len(cache) + len(missing) > self.cache_words:
                cache.clear()
                missing = set(words)
            for w in missing:
                (cache if len(w) <= LONGEST else long)[w] = self.word(SPACE + w)
        if long:
            return sum(cache[w] if len(w) <= LONGEST else long[w] for w in words)
        return sum(map(cache.__getitem__, words))


@lru_cache(maxsize=2)
def shared_counter(model_path: str) -> UnigramCounter:
    """One counter for each worker process: its cache outlives a task."""
    return UnigramCounter(vocabulary(model_path))


def count_tokens(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of docs: id and n_tokens (long). Null and empty texts have none, repeated rows and ids are each
    counted, an empty table gives an empty result; other columns aren't read. A text is counted by one task, which holds
    its words."""
    key_field = docs.select(id_col).schema[0]

    def run(batches: Iterator[pa.RecordBatch]):
        count = shared_counter(model_path).count
        for batch in batches:
            counts = pa.array([count(x) for x in batch.column(1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), counts], [id_col, "n_tokens"])

    schema = f"`{id_col}` {key_field.dataType.simpleString()}, n_tokens long"
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


QUERIES = {"op9_token_counts": op9_token_counts}
ORACLES: dict[str, str] = {}
