"""BPE encoding and decoding of texts with a word-level tokenizer file.

The file is the JSON of a BPE tokenizer with an NFC, lower-case normaliser, a splitting
pattern, byte symbols and a word-end suffix. Words are encoded by `PrefixBPE`: tokens that
end at a position, tested against the last token of what is before, then back-pointers.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string as parse

from corpuslab.llm.prefixbpe import END, PrefixBPE
from corpuslab.llm.rows import packed, quoted, slices, unpacked
from corpuslab.llm.worker import kept

#: The memo of words is thinned out beyond so many words or characters.
WORDS_KEPT, CHARS_KEPT = 300_000, 6_000_000
#: Pieces that are encoded together.
PIECES_A_RUN = 8_192
#: Words of more characters than this are encoded one by one.
LONG_WORD = 64
# White space as the tokenizer's pattern has it; str.split() also cuts at \x1c-\x1f.
WHITE = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
SPACE = re.compile("[" + "".join(map(chr, WHITE)) + "]+")
ODD_SPACE = re.compile("[\x1c-\x1f]")


def byte_symbols() -> list[str]:
    """The character that stands for each byte: printable ones for themselves, the others,
    in order, from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, spare = [], 256
    for b in range(256):
        out.append(chr(b) if b in plain else chr(spare))
        spare += b not in plain
    return out


class WordBPE:
    """Encoder and decoder of one tokenizer file, given as its text."""

    def __init__(self, text: str):
        spec = json.loads(text)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        vocab = model["vocab"]
        self.vocab = vocab
        self.shown = {i: t for t, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.shown |= {i: t for t, i in self.special.items()}
        self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.cut_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.symbols = byte_symbols()
        pairs, order, parts = {}, dict.fromkeys(vocab.values()), {}
        for rank, merge in enumerate(model["merges"]):
            a, b = (vocab[x] for x in (merge if isinstance(merge, list) else merge.split(" ")))
            made = vocab[self.shown[a] + self.shown[b]]
            pairs.setdefault((a, b), made)
            if order[made] is None:
                order[made], parts[made] = rank, (a, b)
        texts = {i: t.removesuffix(self.suffix) + END if self.suffix and t.endswith(self.suffix) else t for t, i in vocab.items()}
        self.order, self.join = order, lambda a, b: pairs.get((a, b))
        self.bpe = PrefixBPE(texts, order, self.join, parts.get)
        # Codes of the symbols by byte. Words and their pieces hold no white space: in a joined list, line ends
        # stand for the end of a word and carriage returns for the border between two.
        self.codes = np.array([ord(c) for c in self.symbols], np.uint32)
        self.codes[[10, 13]] = ord(END), 0
        self.forget()

    def forget(self) -> None:
        """Begin the memo anew: number of each word, its uses, and the ids of word n at begins[n] .. begins[n + 1]."""
        self.number: dict[str, int] = {}
        self.ids, self.begins, self.uses, self.chars = np.empty(0, np.uint32), np.zeros(1, np.int64), np.empty(0, np.int64), 0

    def thin(self) -> None:
        """Keep the words that were met again, or none if these alone fill half of the memo."""
        again = self.uses > 1
        kept, at = [w for w, a in zip(self.number, again.tolist()) if a], np.flatnonzero(again)
        ids, begins = self.ids, self.begins
        self.forget()
        if 2 * len(kept) <= WORDS_KEPT and 2 * (size := sum(map(len, kept))) <= CHARS_KEPT:
            many = begins[at + 1] - begins[at]
            self.number, self.chars = dict(zip(kept, range(len(kept)))), size
            self.ids, self.begins, self.uses = ids[_ranges(begins[at], many)], np.concatenate([[0], np.cumsum(many)]), np.zeros(len(kept), np.int64)

    def _symbols(self, pieces: list[str]) -> str:
        """Symbol strings of many pieces, joined by NUL."""
        end = b"\n" if self.suffix else b""
        raw = (end + b"\r").join([p.encode() for p in pieces]) + end
        return self.codes[np.frombuffer(raw, np.uint8)].tobytes().decode("utf-32-le")

    def _piece(self, piece: str) -> list[int]:
        return self.bpe.encode(self._symbols([piece]))

    def plain(self, text: str) -> str:
        # Each character for itself: a capital sigma has one small form wherever it stands.
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def ids_of(self, word: str) -> list[int]:
        """Ids of a text without white space."""
        ids = []
        for part in self.cut_special.split(word) if self.cut_special and "<" in word else (word,):
            if part in self.special:
                ids.append(self.special[part])
            elif part:
                for piece in self.pattern.findall(self.plain(part)):
                    ids += self._piece(piece)
        return ids

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many words, one after the other, and how many each has."""
        numbers: dict[str, int] = {}
        of_words, alone = [], {}
        for i, (word, plain) in enumerate(zip(words, self.plain("\n".join(words)).split("\n"))):
            if len(plain) > LONG_WORD or self.cut_special and "<" in word:
                alone[i], pieces = self.ids_of(word), ()
            else:
                pieces = self.pattern.findall(plain)
            of_words.append([numbers.setdefault(p, len(numbers)) for p in pieces])
        pieces = list(numbers)
        ids, many = (np.concatenate(x) for x in zip((np.empty(0, np.int64),) * 2, *[self.bpe.encode_many(self._symbols(pieces[i : i + PIECES_A_RUN])) for i in range(0, len(pieces), PIECES_A_RUN)]))
        begins = np.cumsum(many) - many
        used = np.fromiter(chain.from_iterable(of_words), np.int64)
        pieces_of = np.fromiter(map(len, of_words), np.int64, len(words))
        out, ends = ids[_ranges(begins[used], many[used])], np.concatenate([[0], np.cumsum(many[used])])
        last = np.cumsum(pieces_of)
        count = ends[last] - ends[last - pieces_of]
        if alone:
            cut = np.split(out, np.cumsum(count)[:-1])
            for i, x in alone.items():
                cut[i], count[i] = np.array(x, np.int64), len(x)
            out = np.concatenate(cut)
        return out, count

    def split(self, text: str) -> list[str]:
        return [w for w in SPACE.split(text) if w] if ODD_SPACE.search(text) else text.split()

    def encode_texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and where each text begins and the last one ends."""
        split = list(map(self.split, texts))
        words = list(chain.from_iterable(split))
        fresh = [w for w in dict.fromkeys(words) if w not in self.number]
        size = sum(map(len, fresh))
        if self.number and (len(self.number) + len(fresh) > WORDS_KEPT or self.chars + size > CHARS_KEPT):
            self.thin()
            fresh = [w for w in dict.fromkeys(words) if w not in self.number]
            size = sum(map(len, fresh))
        if fresh:
            ids, count = self._words(fresh)
            self.number.update(zip(fresh, range(len(self.number), len(self.number) + len(fresh))))
            self.ids, self.begins = np.concatenate([self.ids, ids.astype(np.uint32)]), np.concatenate([self.begins, self.begins[-1] + np.cumsum(count)])
            self.uses = np.concatenate([self.uses, np.zeros(len(fresh), np.int64)])
            self.chars += size
        number = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))
        self.uses += np.bincount(number, minlength=len(self.uses))
        many = self.begins[number + 1] - self.begins[number]
        ends = np.concatenate([[0], np.cumsum(many)])
        at = np.concatenate([[0], np.cumsum(np.fromiter(map(len, split), np.int64, len(split)))])
        return self.ids[_ranges(self.begins[number], many)], ends[at]

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return self.encode_texts([text])[0].astype("<u4").tobytes()

    def decode(self, ids: bytes) -> str:
        """Tokens of packed ids, one space between, as no decoder is set in the file."""
        return " ".join([self.shown[i] for i in np.frombuffer(ids, "<u4").tolist()])

    def both(self, text: str) -> tuple[bytes, str]:
        """Packed ids and decoded text."""
        packed = self.encode(text)
        return packed, self.decode(packed)


def _ranges(begins: np.ndarray, many: np.ndarray) -> np.ndarray:
    """begins[0], begins[0] + 1, .. many[0] numbers, then those of the next range."""
    ends = np.cumsum(many)
    return np.repeat(begins - (ends - many), many) + np.arange(int(ends[-1]) if len(ends) else 0)


def _model(source) -> WordBPE:
    text = source.value
    return kept(("wordbpe", hashlib.sha1(text.encode()).hexdigest()), lambda: WordBPE(text))


def share(spark, path: str, most: int = 64 << 20):
    """The tokenizer file at `path`, read by the driver and sent to the executors. Its size is
    checked: a vocabulary, not data."""
    with open(path, encoding="utf-8") as f:
        text = f.read(most + 1)
    if len(text) > most:
        raise ValueError(f"{path}: not a tokenizer file")
    return spark.sparkContext.broadcast(text)


def encode(docs: DataFrame, path: str, column: str = "text", keep: list[str] | None = None, texts: bool = True, forget: bool = False) -> DataFrame:
    """Adds bpe_n_tokens (long), bpe_ids_sha256, bpe_decoded_sha256 and, with `texts`,
    bpe_ids (array<long>) and bpe_decoded to the columns `keep` (default: all) of `docs`.

    The contract columns are lower-case hex of the packed ids and of the decoded UTF-8 text.
    `forget`: a worker keeps the tokenizer but not the memo of words from task to task, which leaves memory to what runs beside it.
    A null text is an empty one: no ids, an empty decoded text. Work is by row: repeated rows
    give repeated results, an empty table an empty one. A column of `docs` of the name of a
    result gives way to it."""
    source = share(docs.sparkSession, path)
    added = "bpe_n_tokens long, bpe_ids_sha256 string, bpe_decoded_sha256 string" + ", bpe_ids array<long>, bpe_decoded string" * texts
    rows = docs.select(F.col(quoted(column)).alias("text"), packed(docs, keep).alias("row"))
    kinds = to_arrow_schema(parse(added))

    def run(batches):
        model = _model(source)
        for part, raw in slices(batches):
            ids, at = model.encode_texts([x.decode() for x in raw])
            tokens = list(map(model.shown.__getitem__, ids.tolist()))
            shown = [" ".join(tokens[a:b]) for a, b in zip(at, at[1:])]
            bytes_ = ids.astype("<u4")
            out = [
                pa.array(np.diff(at)), pa.array([hashlib.sha256(bytes_[a:b]).hexdigest() for a, b in zip(at, at[1:])]),
                pa.array([hashlib.sha256(x.encode()).hexdigest() for x in shown]),
            ]
            if texts:
                out += [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int64())), pa.array(shown, pa.string())]
            yield pa.RecordBatch.from_arrays([part.column(1), *[x.cast(k) for x, k in zip(out, kinds.types)]], names=["row", *kinds.names])
        if forget:
            model.forget()

    return unpacked(rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, " + added), kinds.names)
