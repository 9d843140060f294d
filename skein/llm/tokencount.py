"""Token counts of whole texts by overlap resynchronisation.

A text beyond ``chunk_chars`` is cut into overlapping chunks that are encoded
with offsets.  Two neighbours are spliced at a boundary that both encodings
share and that is proven stable; where the overlap has none, it is widened,
and behind the splice chunks are of the usual size again.

Stable places.  The pre-tokeniser matches from left to right without looking
back, so from a place that always begins a pre-token the rest of the text is
encoded alike whatever stands before.  Two kinds of places always do: a white
space before a non-space other than ``<`` (see ``parts``), and a punctuation mark behind a
letter, as no alternative of the pattern holds a mark after a letter.  The
second kind serves scripts that are written without blanks.  Letters and marks
are listed by ranges that every Unicode version sees alike, and the marks are
none of those in special strings.

Ordinary texts fall into parts at places of the first kind, whose counts add
up; each worker keeps the counts of recent parts.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import arrow_map
from skein.llm.parts import CACHE_PARTS, PartStore

#: Texts longer than this go through the chunked path.
CHUNK_CHARS = 65_536
OVERLAP_CHARS = 1_024

_WORKER: dict[str, object] = {}
_LETTER = "A-Za-zΑ-ΡΣ-ωА-яא-תء-غف-يअ-हก-ะぁ-ゖァ-ヺ一-龥가-힣"
_MARK = ".,;:!?،؛؟।、。「」『』！（），：；？"
_STABLE = re.compile(rf"[ \n\t\r\v\f](?=[^\s<])|(?<=[{_LETTER}])(?=[{_MARK}])")

Token = tuple[int, int, int]


def load_tokenizer(path: str):
    """The tokenizer of a ``.json`` file, single-threaded, one per worker."""
    if path not in _WORKER:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        odd = [t.content for t in tokenizer.get_added_tokens_decoder().values() if not t.content.startswith("<") or re.search(r"\s", t.content)]
        if odd:
            raise ValueError(f"the stable places are proven for special strings like <...> only: {odd}")
        _WORKER[path] = tokenizer
    return _WORKER[path]


def stable_places(text: str, lo: int, hi: int) -> list[int]:
    """Places in [lo, hi) at which a pre-token always begins."""
    return [m.start() for m in _STABLE.finditer(text, lo, min(len(text), hi + 1)) if m.start() < hi]


class Resync:
    """Encodes one text in overlapping chunks; ``encodes`` counts the calls."""

    def __init__(self, tokenizer, text: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS):
        self.tokenizer, self.text, self.chunk, self.overlap = tokenizer, text, chunk, overlap
        self.encodes = 0

    def _offsets(self, lo: int, hi: int) -> list[Token]:
        self.encodes += 1
        e = self.tokenizer.encode(self.text[lo:hi], add_special_tokens=False)
        return [(i, lo + a, lo + b) for i, (a, b) in zip(e.ids, e.offsets)]

    def runs(self) -> Iterator[list[Token]]:
        """``(id, start, end)`` of the text's tokens, splice by splice.

        ``left`` is encoded from ``done``, a proven boundary, to ``end``.  Its
        neighbour starts ``overlap`` before ``end``; the splice is the last
        common stable boundary of both.  Without one the overlap doubles, and
        once it is all of ``left``, ``left`` itself is read further.
        """
        n, done = len(self.text), 0
        end = min(n, self.chunk)
        left = self._offsets(0, end)
        while end < n:
            reach, width, cut = self.chunk, self.overlap, None
            while cut is None and end < n:
                start = max(done, end - width)
                if start > done:
                    far = min(n, start + max(reach, 2 * width))
                    right = self._offsets(start, far)
                    cut = _splice(self.text, left, right, start, end)
                    width *= 2
                else:
                    reach *= 2
                    end = min(n, done + reach)
                    left, width = self._offsets(done, end), self.overlap
            if cut is not None:
                yield [t for t in left if t[1] < cut]
                left = [t for t in right if t[1] >= cut]
                done, end = cut, far
        yield left


def _splice(text: str, left: list[Token], right: list[Token], lo: int, hi: int) -> int | None:
    """The last place in (lo, hi) that begins a token on both sides, is proven
    stable, and from which both sides agree up to the next such place."""
    ends = [[t for t in side if lo < t[1] < hi] for side in (left, right)]
    starts = {t[1] for t in ends[0]} & {t[1] for t in ends[1]}
    good = [p for p in stable_places(text, lo + 1, hi) if p in starts]
    for a, b in zip(reversed(good[:-1]), reversed(good[1:])):
        if [t for t in ends[0] if a <= t[1] < b] == [t for t in ends[1] if a <= t[1] < b]:
            return a
    return None


def encode_resync(tokenizer, text: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> list[Token]:
    """``(id, start, end)`` of each token of ``text``, encoded in chunks."""
    return [t for run in Resync(tokenizer, text, chunk, overlap).runs() for t in run]


class PartCounter:
    """Token counts of texts by their parts."""

    def __init__(self, path: str, cache_parts: int = CACHE_PARTS):
        self.tokenizer = load_tokenizer(path)
        self.store = PartStore(lambda new: [len(e) for e in self.tokenizer.encode_batch_fast(new, add_special_tokens=False)], cache_parts)

    def count(self, texts: list[str]) -> list[int]:
        parts = self.store.of(texts)
        return parts.sums(np.array(parts.values, np.int64)).tolist()


def token_counts(
    docs: DataFrame,
    tokenizer_path: str,
    limit: int = 1024,
    chunk_chars: int = CHUNK_CHARS,
    overlap_chars: int = OVERLAP_CHARS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit, n_chunks)`` per row.

    ``n_chunks`` is how many pieces of the text the library encoded, counting
    one for a text of ordinary length.  Null text counts as empty: 0 bytes, 0
    tokens.  Repeated rows and repeated or null ids give one row each.  Other
    columns, whatever their names, are not read.  A map without a shuffle:
    beside a batch of texts, memory holds one chunk's encoding and the bounded
    store, however long a text is.  Only a stretch without any stable place is
    encoded whole, as the library itself does.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        key = ("counter", tokenizer_path)
        counter = _WORKER.setdefault(key, None) or PartCounter(tokenizer_path)
        _WORKER[key] = counter
        texts = [t or "" for t in batch.column(1).to_pylist()]
        short = [i for i, t in enumerate(texts) if len(t) <= chunk_chars]
        n_tokens, n_chunks = [0] * len(texts), [1] * len(texts)
        for lo in range(0, len(short), 1024):
            some = short[lo : lo + 1024]
            for i, n in zip(some, counter.count([texts[i] for i in some])):
                n_tokens[i] = n
        for i, t in enumerate(texts):
            if len(t) > chunk_chars:
                chunks = Resync(counter.tokenizer, t, chunk_chars, overlap_chars)
                n_tokens[i] = sum(map(len, chunks.runs()))
                n_chunks[i] = chunks.encodes
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2), pa.array(n_tokens, pa.int64()), pa.array([n > limit for n in n_tokens], pa.bool_()), pa.array(n_chunks, pa.int64())],
            names=["doc_id", "n_bytes", "n_tokens", "over_limit", "n_chunks"],
        )

    cols = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(text_col).cast("string").alias("text"),
        F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long").alias("n_bytes"),
    )
    return arrow_map(cols, run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, n_chunks long")
