"""Byte-level BPE ids with the ``tokenizers`` library, encoding each distinct chunk once per worker.

A byte-level tokenizer of this family never joins characters across a space that a non-space follows:
the space opens the next pre-token. Texts are cut there, each distinct chunk is encoded by the library
and kept in a bounded cache, and a text's ids are its chunks' ids in a row. Texts that hold the string
of a special token go to the library whole.

Most of the library's time on a new chunk goes to finding its pre-tokens and spelling their bytes, not to
merges. Chunks of printable ASCII, line ends and Latin letters are cut by the library's own rule here,
their pre-tokens are spelt many at a time, and only the merges are the library's.
"""

from __future__ import annotations

import codecs
import itertools
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)

_CUT = re.compile(r" (?=\S)")
_WIDE = re.compile(r" (?!\S)").search
#: Letters in every version of Unicode that a tokenizer may have been built with.
_LETTER = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u02af"
_PLAIN = re.compile(f"[ -~\n{_LETTER}]+").fullmatch
#: Pre-tokens of byte-level tokenizers, in plain texts.
_PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[0-9]+| ?[^\\s0-9{_LETTER}]+|\\s+(?!\\S)|\\s+").findall
_LOADED: dict[tuple, ChunkEncoder] = {}


def _spelling() -> str:
    """For each byte its character in byte-level vocabularies: printable ones as they are, others from 256 on."""
    others = itertools.count(256)
    return "".join(chr(b if 33 <= b < 127 or 161 <= b and b != 173 else next(others)) for b in range(256))


_SPELT = _spelling()
_END = _SPELT[ord("\n")]


def default_path() -> str:
    """Place of the public vocabulary file that the queries use."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class ChunkEncoder:
    """``encode(texts)`` gives a uint32 array of ids for each text; null counts as empty.

    Cache keys are the chunks without the space that opens them; a text's first chunk, which has none,
    is kept as a 1-tuple. The cache has two generations of at most ``max_chunks`` entries each: when the
    young one is full it becomes the old one, and what is used again moves back.
    """

    def __init__(self, path: str, max_chunks: int = 450_000):
        from tokenizers import Tokenizer, pre_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; threads of its own would wait for it, and each keeps memory

        self.tokenizer = Tokenizer.from_file(path)
        self.max_chunks = max_chunks
        self.young: dict = {}
        self.old: dict = {}
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.newline = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.by_line = len(self.newline) == 1
        rule = self.tokenizer.pre_tokenizer
        self.by_piece = self.by_line and self.tokenizer.normalizer is None and isinstance(rule, pre_tokenizers.ByteLevel) and rule.use_regex and not rule.add_prefix_space
        self.merges = Tokenizer(self.tokenizer.model)  # the same model; it gets spelt pre-tokens, each with a line's end behind it
        self.merges.pre_tokenizer = pre_tokenizers.Split(_END, "isolated")

    @classmethod
    def load(cls, path: str, max_chunks: int | None = None) -> ChunkEncoder:
        key = (path, max_chunks)
        if key not in _LOADED:
            _LOADED[key] = cls(path, *([max_chunks] if max_chunks else []))
        return _LOADED[key]

    def _library(self, texts: list[str], tokenizer=None) -> list[bytes]:
        return [np.asarray(e.ids, np.uint32).tobytes() for e in (tokenizer or self.tokenizer).encode_batch_fast(texts, add_special_tokens=False)]

    def _by_line(self, words: list[str], tokenizer=None, end: str = "\n") -> list[bytes]:
        """Ids of words without line ends, 128 words a text."""
        lines = [end.join(words[j : j + 128]) + end for j in range(0, len(words), 128)]
        ids = np.frombuffer(b"".join(self._library(lines, tokenizer)), np.uint32)
        ends = np.flatnonzero(ids == self.newline[0]) * 4
        if len(ends) != len(words):
            raise ValueError("the tokenizer joins a line's end to other characters")
        flat, ends = ids.tobytes(), ends.tolist()
        return [flat[a:b] for a, b in zip([0, *(x + 4 for x in ends)], ends)]

    def _merged(self, pieces: list[str]) -> list[bytes]:
        """Ids of pre-tokens without line ends."""
        spelt = codecs.charmap_decode("\n".join(pieces).encode(), "strict", _SPELT)[0].split(_END) if pieces else []
        return self._by_line(spelt, self.merges, _END)

    def _learn_pieces(self, keys: list) -> None:
        """Keys of plain characters by their pre-tokens, of which a word may be known."""
        young = self.young
        cut = [_PIECES(" " + k if type(k) is str else k[0]) for k in keys]
        known = {p: young.get(p[1:] if p[0] == " " else (p,)) for p in set(itertools.chain.from_iterable(cut))}
        new = [p for p, ids in known.items() if ids is None]
        ends = [p for p in new if "\n" in p]
        known.update(zip(ends, self._library(ends)))
        new = [p for p in new if "\n" not in p]
        known.update(zip(new, self._merged(new)))
        get = known.__getitem__
        young.update([(k, b"".join(map(get, pieces))) for k, pieces in zip(keys, cut)])

    def _learn_together(self, keys: list[str]) -> None:
        """Plain keys without spaces inside: one cut of all of them, in which a space opens each key, and one look at each distinct piece."""
        pieces = pa.array(_PIECES(" " + " ".join(keys)), pa.string()).dictionary_encode()
        names, young = pieces.dictionary.to_pylist(), self.young
        opens = np.fromiter((p[0] == " " for p in names), bool, len(names))
        known = [young.get(p[1:] if p[0] == " " else (p,)) for p in names]
        gaps = [j for j, ids in enumerate(known) if ids is None]
        for some, learn in (([j for j in gaps if "\n" in names[j]], self._library), ([j for j in gaps if "\n" not in names[j]], self._merged)):
            for j, ids in zip(some, learn([names[j] for j in some])):
                known[j] = ids
        at = pieces.indices.to_numpy()
        sizes = np.fromiter(map(len, known), np.int64, len(known))[at]
        first = np.flatnonzero(opens[at])
        if len(first) != len(keys):
            raise ValueError("a chunk of plain characters holds a space")
        ends = np.concatenate([[0], np.cumsum(sizes)])
        flat, bounds = b"".join(map(known.__getitem__, at.tolist())), [*ends[first].tolist(), int(ends[-1])]
        young.update(zip(keys, [flat[a:b] for a, b in zip(bounds, bounds[1:])]))

    def _learn(self, keys: list) -> None:
        """Plain keys go by their pre-tokens, other words to the library a hundred lines at a time (a line's end is a token of its own there)."""
        by_text = [k for k in keys if type(k) is not str]
        keys = [k for k in keys if type(k) is str]
        if self.by_piece:
            plain = list(filter(_PLAIN, keys))
            spaced = [k for k in plain if " " in k]
            if spaced:
                plain = [k for k in plain if " " not in k]
            for i in range(0, len(plain), 102_400):
                self._learn_together(plain[i : i + 102_400])
            spaced += [k for k in by_text if _PLAIN(k[0])]
            for i in range(0, len(spaced), 25_600):
                self._learn_pieces(spaced[i : i + 25_600])
        rest = [k for k in keys if k not in self.young]
        words = [k for k in rest if "\n" not in k and not k[-1].isspace()] if self.by_line else []
        for i in range(0, len(words), 25_600):
            part = words[i : i + 25_600]
            self.young.update(zip(part, self._by_line([" " + w for w in part])))
        rest = [k for k in (*rest, *by_text) if k not in self.young]
        for i in range(0, len(rest), 25_600):
            part = rest[i : i + 25_600]
            self.young.update(zip(part, self._library([k[0] if isinstance(k, tuple) else " " + k for k in part])))

    def _fetch(self, missing: set) -> None:
        """Bring chunks into the young generation, from the old one or from the library."""
        if len(self.young) + len(missing) > self.max_chunks:
            self.young, self.old = {}, self.young
        self.young.update({k: self.old[k] for k in missing if k in self.old})
        self._learn([k for k in missing if k not in self.young])

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Every distinct chunk of the texts is looked up once. Texts are cut at all spaces, those with a space before white space or an end by the rule."""
        out: list = [None] * len(texts)
        heads, narrow, wide = {}, {}, {}
        for i, text in enumerate(texts):
            if not text or any(s in text for s in self.special):
                out[i] = np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids if text else [], np.uint32)
            elif _WIDE(text):
                heads[i], *wide[i] = _CUT.split(text)
            else:
                heads[i], space, tail = text.partition(" ")
                narrow[i] = tail if space else None
        if not heads:
            return out
        cut = pa.compute.split_pattern(pa.array(narrow.values(), pa.string()), " ")
        sizes = [*pa.compute.fill_null(pa.compute.list_value_length(cut), 0).to_pylist(), *map(len, wide.values())]
        words = pa.concat_arrays([cut.flatten(), pa.array(itertools.chain.from_iterable(wide.values()), pa.string())]).dictionary_encode()
        keys = words.dictionary.to_numpy(zero_copy_only=False).tolist() + [(h,) for h in heads.values() if h]
        ids = list(map(self.young.get, keys))
        gaps = [j for j, v in enumerate(ids) if v is None]
        if gaps:
            self._fetch({keys[j] for j in gaps})
            for j in gaps:
                ids[j] = self.young[keys[j]]
        first = iter(ids[len(words.dictionary) :])
        opened = {i: next(first) if h else b"" for i, h in heads.items()}
        flat = pa.array(ids[: len(words.dictionary)], pa.binary()).take(words.indices)
        ends = np.concatenate([[0], np.cumsum(pa.compute.binary_length(flat).to_numpy())])[np.concatenate([[0], np.cumsum(sizes)])].tolist()
        data = memoryview(flat.buffers()[2] or b"")
        for i, a, b in zip([*narrow, *wide], ends, ends[1:]):
            out[i] = np.frombuffer(opened[i] + data[a:b], np.uint32)
        return out
