"""Public vocabularies: read once by the driver, shipped with the task, and looked up piece by piece.

A byte-level vocabulary never merges across the place before a space or a line feed that follows a character which is no
white space. So texts are cut there, and the library encodes each distinct piece once, all new ones of a batch in one call;
texts for which a cut is not certain are encoded whole. Both ways give equal ids."""

from __future__ import annotations

import string
import sys

import pyarrow as pa

from .common import by_value

by_value(__name__)
#: Stems remembered at most, and the characters in them; a batch may exceed them, then those are forgotten that were not met lately.
REMEMBERED, CHARACTERS = 500_000, 9_000_000
#: New pieces that the library encodes in one call.
AT_ONCE = 10_000
#: White space of any engine, and characters that some engine may take for it.
BLANK = frozenset(c for c in map(chr, range(sys.maxunicode + 1)) if c.isspace()) | {"᠎", "​", "﻿"}
BLANKS = pa.array(sorted(BLANK))
BYTE_VOCABULARY, PIECE_VOCABULARY = "byte_bpe_50k.json", "piece_bpe_32k.model"
MARK = "▁"

def content(name: str, path: str | None = None) -> bytes:
    """A vocabulary file as bytes, so executors need no copy: the one at path, else the installed one of this name."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(name)
    with open(path, "rb") as f:
        return f.read()


class ByteLevel:
    """Encodes with a byte-level vocabulary of the tokenizers library; plain takes the strings of special tokens as text."""

    def __init__(self, model: bytes, plain: bool = False):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task a core
        import numpy as np
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_buffer(model)
        self.library.encode_special_tokens = plain
        # what is remembered: stems, the number of ids of each (of a space and the stem, or of the stem if a line feed begins it),
        # their ids one after another, and whether they were met since some were forgotten
        self.characters = 0
        self.stems, self.sizes, self.every, self.met = pa.array([], pa.string()), np.zeros(0, np.int64), np.zeros(0, "<u4"), np.zeros(0, bool)
        # marks that may be cut off after a letter; no special token ends with one
        self.marks = "".join(sorted(set(string.punctuation) - {t.content[-1] for t in self.library.get_added_tokens_decoder().values()}))
        self.latin = pa.array([c for c in map(chr, range(0x250)) if c.isalnum()])
        self.tails: dict[int, list[int]] = {}
        seen = {*range(33, 127), *range(161, 173), *range(174, 256)}
        hidden = iter(range(256, 512))
        self.visible = [chr(b) if b in seen else chr(next(hidden)) for b in range(256)]  # how the vocabulary writes a byte
        self.bytes = self.token_bytes()
        self.begins = np.array([b[:1] in (b" ", b"\n") for b in self.bytes])

    @property
    def ids(self) -> dict[str, bytes]:
        """What is remembered, by stem."""
        import numpy as np

        ends = np.cumsum(self.sizes).tolist()
        return {p: self.every[z - n : z].tobytes() for p, z, n in zip(self.stems.to_pylist(), ends, self.sizes.tolist(), strict=True)}

    def whole(self, text: str) -> list[int]:
        return self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def learn(self, stems: pa.Array) -> None:
        """Every stem begins with the one token that holds its space or line feed, so their ids are told apart."""
        import numpy as np
        import pyarrow.compute as pc

        spaced = pc.if_else(pc.starts_with(stems, "\n"), stems, pc.binary_join_element_wise("", stems, " "))
        sizes, every = [self.sizes], [self.every]
        for k in range(0, len(stems), AT_ONCE):
            some = spaced[k : k + AT_ONCE].to_pylist()
            ids = np.array(self.whole("".join(some)), dtype="<u4")
            starts = np.flatnonzero(self.begins[ids])
            if len(starts) != len(some):
                raise ValueError("this vocabulary merges a space with the character before it")
            sizes.append(np.diff(starts, append=len(ids)))
            every.append(ids)
        self.sizes, self.every = np.concatenate(sizes), np.concatenate(every)
        self.stems = pa.concat_arrays([self.stems, stems])
        self.characters += pc.sum(pc.utf8_length(stems)).as_py() or 0
        self.met = np.concatenate([self.met, np.ones(len(stems), dtype=bool)])

    def forget(self) -> None:
        """Keeps what was met since the last time, or nothing if that is too much as well."""
        import numpy as np
        import pyarrow.compute as pc

        keep = self.met
        if keep.sum() > REMEMBERED // 2 or 2 * (pc.sum(pc.utf8_length(self.stems.filter(pa.array(keep)))).as_py() or 0) > CHARACTERS:
            keep = np.zeros(len(keep), dtype=bool)
        self.every, self.sizes = self.every[np.repeat(keep, self.sizes)], self.sizes[keep]
        self.stems, self.met = self.stems.filter(pa.array(keep)), np.zeros(int(keep.sum()), dtype=bool)
        self.characters = pc.sum(pc.utf8_length(self.stems)).as_py() or 0

    def cut(self, pieces: pa.Array):
        """(stems, tails): pieces without the few marks at their ends, if a letter or digit of the Latin blocks stands before
        them, since there a token ends for certain; and the bytes of these marks as one number each, 0 if there are none."""
        import numpy as np
        import pyarrow.compute as pc

        short = pc.utf8_rtrim(pieces, characters=self.marks)
        whole, size = (np.asarray(pc.binary_length(x)).astype(np.int64) for x in (pieces, short))
        ends = pc.is_in(pc.utf8_slice_codeunits(short, -1), value_set=self.latin).to_numpy(zero_copy_only=False)
        cut = np.flatnonzero(ends & (whole > size) & (whole - size <= 8))
        is_cut, tails = np.zeros(len(pieces), dtype=bool), np.zeros(len(pieces), dtype=np.uint64)
        is_cut[cut] = True
        if not len(cut):
            return pieces, tails
        offsets, data = np.frombuffer(pieces.buffers()[1], np.int32)[pieces.offset :], np.frombuffer(pieces.buffers()[2], np.uint8)
        first, many = offsets[cut] + size[cut], (whole - size)[cut]
        for k in range(int(many.max(initial=0))):
            has = many > k
            tails[cut[has]] |= data[first[has] + k].astype(np.uint64) << np.uint64(8 * k)
        return pc.if_else(pa.array(is_cut), short, pieces), tails

    def tail(self, marks: int):
        """The ids of marks that follow a letter."""
        found = self.tails.get(marks)
        if found is None:
            text = marks.to_bytes(8, "little").rstrip(b"\0").decode()
            found = self.whole("a" + text)[len(self.whole("a")) :] if text else []
            if len(self.tails) < 10_000:
                self.tails[marks] = found
        return found

    def remember(self, pieces: pa.Array):
        """(ids, sizes) of distinct pieces, looked up or learned: their ids in one array, and how many each has; none for a
        piece that is empty or next to white space, where the cut is not certain."""
        import numpy as np
        import pyarrow.compute as pc

        if len(self.stems) > REMEMBERED or self.characters > CHARACTERS:
            self.forget()
        stems, tails = self.cut(pieces)
        coded = stems.dictionary_encode()
        at, nr = pc.index_in(coded.dictionary, value_set=self.stems), coded.indices.to_numpy()
        gaps = coded.dictionary.filter(pc.is_null(at))
        last, second = pc.utf8_slice_codeunits(gaps, -1), pc.utf8_slice_codeunits(gaps, 1, 2)
        sure = pc.invert(pc.or_(pc.or_(pc.equal(gaps, ""), pc.is_in(last, value_set=BLANKS)), pc.and_(pc.starts_with(gaps, "\n"), pc.is_in(second, value_set=BLANKS))))
        n_known = len(self.stems)
        self.learn(gaps.filter(sure))
        # places of the new ones follow each other; those that are not sure have no place
        at, sure = pc.fill_null(at, -1).to_numpy().astype(np.int64), sure.to_numpy(zero_copy_only=False)
        at[at < 0] = np.where(sure, n_known - 1 + np.cumsum(sure), -1)
        self.met[at[at >= 0]] = True
        at = at[nr]
        sizes, firsts = np.append(self.sizes, 0)[at], np.append(np.cumsum(self.sizes) - self.sizes, 0)[at]
        kinds, kind = np.unique(tails, return_inverse=True)
        ends = [self.tail(int(t)) for t in kinds]
        end_sizes = np.array([len(e) for e in ends], dtype=np.int64)
        end_firsts = np.cumsum(end_sizes) - end_sizes
        more = np.where(at >= 0, end_sizes[kind], 0)
        total = sizes + more
        begin, ids = np.cumsum(total) - total, np.empty(int(total.sum()), dtype="<u4")
        for source, start, size, to in ((self.every, firsts, sizes, begin), (np.array([i for e in ends for i in e], dtype="<u4"), end_firsts[kind], more, begin + sizes)):
            step = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
            ids[np.repeat(to, size) + step] = source[np.repeat(start, size) + step]
        return ids, total

    def encode(self, texts: list[str] | pa.Array) -> list[bytes]:
        """The ids of each text, as little-endian bytes of four an id. Arrow cuts the texts and tells the distinct pieces, so
        Python handles each of these once, and the ids of all places are picked from theirs as one array."""
        import numpy as np
        import pyarrow.compute as pc

        texts = pa.array(texts, pa.string()) if isinstance(texts, list) else texts
        if not len(texts):
            return []
        cut = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        ends, flat = np.cumsum(pc.list_value_length(cut).to_numpy()), cut.flatten()
        heads = np.concatenate([[0], ends[:-1]])
        rest = np.ones(len(flat), dtype=bool)
        rest[heads] = False
        coded = flat.filter(pa.array(rest)).dictionary_encode()
        (every, sizes), at = self.remember(coded.dictionary), coded.indices.to_numpy()
        firsts = np.cumsum(sizes) - sizes
        n = sizes[at]
        before = np.concatenate([[0], np.cumsum(n)])
        ids = every[np.repeat(firsts[at] - before[:-1], n) + np.arange(before[-1])]
        doubts = np.concatenate([[0], np.cumsum(n == 0)])
        stops = ends - np.arange(1, len(ends) + 1)  # without the first pieces
        starts = np.concatenate([[0], stops[:-1]])
        unsure, a, z = (doubts[stops] > doubts[starts]).tolist(), before[starts].tolist(), before[stops].tolist()
        out = []
        for k, first in enumerate(flat.take(pa.array(heads)).to_pylist()):
            if unsure[k] or (first and first[-1] in BLANK):
                out.append(pack(self.whole(texts[k].as_py())))
            else:
                body = ids[a[k] : z[k]].tobytes()
                out.append(pack(self.whole(first)) + body if first else body)
        return out

    def token_bytes(self) -> list[bytes]:
        """The bytes of every id: the visible characters of the vocabulary stand for one byte each."""
        back = {c: b for b, c in enumerate(self.visible)}
        out = [b""] * self.library.get_vocab_size()
        for token, i in self.library.get_vocab().items():
            out[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode("utf-8")
        return out


def shared(kind: type, model: bytes, **options):
    """One tool in each worker process: Spark reuses its workers, so a task finds what earlier ones have learned."""
    tools = vars(sys).setdefault("_shared_vocabularies", {})
    key = (kind.__name__, hash(model), *options.items())
    if key not in tools:
        tools[key] = kind(model, **options)
    return tools[key]


class SentencePiece:
    """Encodes with a sentencepiece vocabulary, which puts a space before the text."""

    def __init__(self, model: bytes):
        from sentencepiece import SentencePieceProcessor

        self.library = SentencePieceProcessor(model_proto=model)
        names = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
        #: The mark is a space, <0xHH> a byte.
        self.bytes = [bytes([int(n[3:5], 16)]) if len(n) == 6 and n.startswith("<0x") and n.endswith(">") else n.replace(MARK, " ").encode("utf-8") for n in names]

    def encode(self, texts: list[str]) -> list[bytes]:
        return [pack(ids) for ids in self.library.encode(texts, num_threads=1)]


def pack(ids: list[int]) -> bytes:
    import numpy as np

    return np.array(ids, dtype="<u4").tobytes()
