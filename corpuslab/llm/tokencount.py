"""Token counts of a sentence-piece BPE model, at every prefix of a text.

Prefix dynamic programming (`PrefixBPE.table`) gives the exact number of tokens of each
prefix, as if that prefix were encoded alone; questions about budgets and cuts read that
table and encode nothing again. The table of a text is the chain of the tables of its
chunks: runs of white space with the run of other characters after them. No token of the
vocabulary goes on across a chunk's border, which is checked when the model is read, so
counts add up.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.llm.prefixbpe import PrefixBPE
from corpuslab.llm.rows import batched
from corpuslab.llm.worker import Bounded, kept

CHUNKS_KEPT = 500_000
SPACE = "▁"


class PieceCounter:
    """Prefix counts by one model, given as the bytes of its file. The model must be BPE
    without text rewriting rules beyond the mark for spaces."""

    def __init__(self, data: bytes):
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        model.ParseFromString(data)
        rules = model.normalizer_spec
        if model.trainer_spec.model_type != proto.TrainerSpec.BPE or rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.escape_whitespaces or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only BPE models that leave texts as they are can be counted")
        kind = proto.ModelProto.SentencePiece
        if any(p.type in (kind.USER_DEFINED, kind.UNUSED) for p in model.pieces):
            raise ValueError("models with user-defined or unused pieces are not supported")
        self.lead = SPACE if rules.add_dummy_prefix else ""
        self.bytes_out = model.trainer_spec.byte_fallback
        ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == kind.NORMAL}
        score = {i: -model.pieces[i].score for i in ids.values()}
        long = {t for t in ids if len(t) > 1}
        if any(SPACE in t.lstrip(SPACE) for t in long):
            raise ValueError("a piece goes on across a space")
        self.single = {t for t in ids if len(t) == 1}
        merging = "".join(sorted({c for t in long for c in t} - {SPACE}))
        self.chunk = re.compile(f"{SPACE}*[{re.escape(merging)}]+|{SPACE}+|.", re.S)
        # A character of a longer piece that is no piece itself is a base symbol without an id of its own.
        texts, order = {i: t for t, i in ids.items()}, {i: (None if len(t) == 1 else score[i]) for t, i in ids.items()}
        for c in merging + SPACE:
            if c not in ids:
                i = len(model.pieces) + ord(c)
                ids[c], texts[i], order[i] = i, c, None
        self.ids, self.texts, self.order = ids, texts, order
        self.join = lambda a, b: ids.get(texts[a] + texts[b])
        self.bpe = PrefixBPE(texts, order, self.join, self._parts)
        self.counts = Bounded(self._count, CHUNKS_KEPT)

    def _parts(self, token: int):
        """The two tokens that merging the characters of a piece joins last."""
        from corpuslab.llm.prefixbpe import merge_by_rank

        made = {}

        def join(a, b):
            t = self.join(a, b)
            if t == token:
                made[t] = (a, b)
            return t

        ends = merge_by_rank([self.ids[c] for c in self.texts[token]], self.order, join)
        return made.get(token) if ends == [token] else None

    def _alone(self, char: str) -> int:
        return 1 if char in self.single or not self.bytes_out else len(char.encode())

    def _table(self, chunk: str) -> list[int]:
        """Counts of the prefixes of a chunk."""
        if len(chunk) == 1:
            return [0, self._alone(chunk)]
        last, begin, count = self.bpe.table(chunk)
        if all(c in self.single for c in chunk):
            return count
        # Base symbols without an id are written as bytes.
        for at in range(1, len(chunk) + 1):
            count[at] = count[begin[at]] + (self._alone(chunk[begin[at]]) if at - begin[at] == 1 else 1)
        return count

    def _count(self, chunk: str) -> int:
        return self._table(chunk)[-1]

    def marked(self, text: str) -> str:
        return self.lead + text.replace(" ", SPACE) if text else ""

    def count(self, text: str) -> int:
        counts = self.counts
        return sum([counts[c] for c in self.chunk.findall(self.marked(text))])

    def prefixes(self, text: str) -> list[int]:
        """Token counts of text[:0], text[:1], .., the whole text."""
        out, base, lead = [0], 0, len(self.lead)
        for chunk in self.chunk.findall(self.marked(text)):
            table = self._table(chunk)
            out += [base + n for n in table[1 + lead :]]
            lead = 0
            base += table[-1]
        return out

    def cut(self, text: str, budget: int) -> int:
        """Characters of the longest prefix with at most `budget` tokens. Counts of prefixes
        can fall where a merge begins, so the whole table is looked at."""
        return max(i for i, n in enumerate(self.prefixes(text)) if n <= budget)


def _model(source) -> PieceCounter:
    return kept(("pieces", hashlib.sha1(source.value).hexdigest()), lambda: PieceCounter(source.value))


def share(spark, path: str, most: int = 64 << 20):
    """The model file at `path`, read by the driver and sent to the executors, size checked."""
    with open(path, "rb") as f:
        data = f.read(most + 1)
    if len(data) > most:
        raise ValueError(f"{path}: not a model file")
    return spark.sparkContext.broadcast(data)


def _rows(docs: DataFrame, path: str, column: str, keep: list[str] | None, added: str, fn) -> DataFrame:
    source = share(docs.sparkSession, path)
    many = added.count(",") + 1

    def run(texts):
        model = _model(source)
        return list(zip(*[fn(model, t or "") for t in texts])) or [[]] * many

    return batched(docs, {"text": column}, keep, added, run)


def counts(docs: DataFrame, path: str, limit: int, column: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds n_bytes, n_tokens (long) and over_limit (more than `limit` tokens) to the columns
    `keep` (default: all). A null text counts as empty: 0, 0, false. Work is by row, so
    repeated rows and empty tables need no care; a column of the name of a result gives way."""
    out = _rows(docs, path, column, keep, "n_bytes long, n_tokens long", lambda m, t: (len(t.encode()), m.count(t)))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


def truncated(docs: DataFrame, path: str, budget: int, column: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds cut_text, the longest prefix with at most `budget` tokens, and cut_tokens."""
    def one(model, text):
        table = model.prefixes(text)
        at = max(i for i, n in enumerate(table) if n <= budget)
        return text[:at], table[at]

    return _rows(docs, path, column, keep, "cut_text string, cut_tokens long", one)


def prefix_counts(docs: DataFrame, path: str, column: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds prefix_tokens (array<long>): the token count of every prefix, the empty one first."""
    return _rows(docs, path, column, keep, "prefix_tokens array<long>", lambda m, t: (m.prefixes(t),))
