"""Token ids of whole texts, by the tokenizers library, with a bounded cache of words.

Byte-level BPE splits a text before merging: a run of blanks followed by a run
of other characters never shares a token with what comes before or after it.
Such chunks repeat, so each is encoded once and kept as its ids' bytes. Arrow
cuts a batch's texts into chunks and numbers the distinct ones, and cuts those
before the marks that end them, as the tokenizer does: a new chunk like "word.,"
costs nothing where "word" is known.
"""

from __future__ import annotations

import re
import sys
import types

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = re.compile(r"\s*\S+|\s+$")
#: Characters that Python counts as blank and the tokenizer's pattern does not.
ODD = re.compile(r"[\x1c-\x1f]")
#: RE2, texts that are not words between single spaces or line ends: other blanks, two blanks together, blanks at an end, none at all, the mark itself.
UNEVEN = r"[\x00\x09\x0b-\x0d\x1c-\x1f\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|[ \n][ \n]|\A[ \n]|[ \n]\z|\A\z"
#: Letters that are such in each version of Unicode since 5.0.
LETTERS = r"A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
WORD = re.compile(rf"\0?[{LETTERS}]+")
#: RE2, a letter and the ASCII marks that end a chunk: nothing that the tokenizer's pattern finds holds both in this order.
SEAM = r"([A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}])([!-/:-@\[-`{-~]+)\z"


def chunks(text: str) -> list[str]:
    """Chunks that are encoded apart, with a mark before each."""
    if ODD.search(text):
        return ["\0" + text]
    return ["\0" + c for c in CHUNK.findall(text)]


def laid(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray, index: np.ndarray) -> np.ndarray:
    """The slices ``values[starts[i] : starts[i] + sizes[i]]`` for all i of ``index``, one after another."""
    out = [values[:0]]
    for at in range(0, len(index), 1 << 20):
        part = index[at : at + (1 << 20)]
        n = sizes[part]
        out.append(values[np.repeat(starts[part] - np.cumsum(n) + n, n) + np.arange(n.sum())])
    return np.concatenate(out)


def distinct(strings: pa.Array) -> tuple[pa.Array, np.ndarray]:
    coded = strings.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy()


def byte_characters() -> dict[int, int]:
    """The character that byte-level BPE writes for each byte."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {b: b for b in shown} | {b: 256 + k for k, b in enumerate(sorted(set(range(256)).difference(shown)))}


class Encoder:
    """``ids(texts)`` gives the little-endian unsigned 32-bit ids of each text as bytes.

    Two generations of about ``most`` pieces are kept: when the young one is
    full it becomes the old one, and what is used again moves back.
    """

    def __init__(self, path: str, most: int = 250_000):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.lengths = np.zeros(self.tokenizer.get_vocab_size(), dtype=np.int64)
        for token, i in self.tokenizer.get_vocab().items():
            self.lengths[i] = len(token)  # a byte is one character of a byte-level token
        # the same model for words that are cut and written byte by byte already
        self.words = Tokenizer.from_file(path)
        self.words.pre_tokenizer = pre_tokenizers.Split("\n", "removed")
        self.characters = byte_characters() | {10: 10}
        # texts that hold an added token are cut at blanks only
        self.uneven = "|".join([UNEVEN, *(re.sub(r"[^A-Za-z0-9]", lambda m: f"\\x{{{ord(m[0]):x}}}", t.content) for t in self.tokenizer.get_added_tokens_decoder().values())])
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.most = most

    def _alone(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _parted(self, ids: list[int], ends: np.ndarray) -> list[bytes] | None:
        """The ids' bytes, cut where the texts' bytes end; None if a token lies across an end."""
        ids = np.array(ids, dtype="<u4")
        upto = np.cumsum(self.lengths[ids])
        cut = np.searchsorted(upto, ends, side="right")
        if cut[-1] != len(ids) or (np.concatenate([[0], upto])[cut] != ends).any():
            return None
        raw, at = ids.tobytes(), (4 * cut).tolist()
        return [raw[a:b] for a, b in zip([0, *at], at)]

    def _encode(self, new: list[str]) -> list[bytes]:
        """Chunks that open with a blank, or get a line end before them, are encoded as one text, whose ids part where the chunks' bytes do."""
        texts = [c[1:] if c[:1] == "\0" else c if c[:1] == "\n" else " " + c for c in new]
        joined = [k for k, t in enumerate(texts) if t and t[0] != "\u180e" and not t[-1].isspace() and not ODD.search(t)]
        out = [b""] * len(texts)
        for at in range(0, len(joined), 1000):
            part = joined[at : at + 1000]
            seen = [x for k in part for x in ("" if texts[k][0].isspace() else "\n", texts[k])]
            ids = self.tokenizer.encode("".join(seen), add_special_tokens=False).ids
            got = self._parted(ids, np.cumsum([len(x.encode()) for x in seen]))
            for k, v in zip(part, got[1::2] if got else [self._alone(texts[k]) for k in part]):
                out[k] = v
        for k in set(range(len(texts))).difference(joined):
            out[k] = self._alone(texts[k])
        return out

    def _encode_words(self, new: list[str]) -> list[bytes]:
        """Runs of letters, after a space or a mark, without the search for where to cut."""
        out = []
        for at in range(0, len(new), 1000):
            part = new[at : at + 1000]
            text = "\n".join([w[1:] if w[0] == "\0" else " " + w for w in part])
            text = text.replace(" ", "\u0120") if text.isascii() else text.encode().decode("latin-1").translate(self.characters)
            ids = self.words.encode(text, add_special_tokens=False).ids
            out += self._parted(ids, np.cumsum([len(w) for w in text.split("\n")])) or self._encode(part)
        return out

    def _values(self, pieces: list[str]) -> list[bytes]:
        """The ids of different pieces."""
        if len(self.young) > self.most:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        out = list(map(young.get, pieces))
        words, others = [], []
        missing = [k for k, v in enumerate(out) if v is None]
        for k in missing:
            c = pieces[k]
            v = old.get(c)
            if v is not None:
                young[c] = v
            elif WORD.fullmatch(c):
                words.append(c)
            else:
                others.append(c)
        words.sort(key=str.isascii)  # a text of ASCII only needs no rewriting
        young.update(zip(words, self._encode_words(words)))
        young.update(zip(others, self._encode(others)))
        for k in missing:
            out[k] = young[pieces[k]]
        return out

    def ids(self, texts: list[str]) -> list[bytes]:
        """Each text's ids; a batch's new chunks are encoded together."""
        column = pa.array(texts, pa.large_string())
        uneven = pc.match_substring_regex(column, self.uneven).to_numpy(zero_copy_only=False)
        # a word after one space is given without that space, other chunks with a mark before them
        lead, none = pa.scalar("\0", pa.large_string()), pa.scalar("", pa.large_string())
        even = pc.binary_join_element_wise(lead, column.filter(pa.array(~uneven)), none)
        even = pc.split_pattern(pc.replace_substring(even, "\n", " \n"), " ")
        rest = [chunks(texts[k]) for k in np.flatnonzero(uneven)]
        many = np.concatenate([pc.list_value_length(even).to_numpy(zero_copy_only=False), [len(r) for r in rest]]).astype(np.int64)
        found, index = distinct(even.flatten())
        others, more = distinct(pa.array([c for r in rest for c in r], pa.large_string()))
        # the different chunks' pieces
        found = pc.replace_substring_regex(pc.replace_substring(found, "\n", "\0\n \0"), SEAM, "\\1 \0\\2")
        found = pc.split_pattern(found, " ")
        parts = np.concatenate([pc.list_value_length(found).to_numpy(zero_copy_only=False), np.ones(len(others))]).astype(np.int64)
        pieces, which = distinct(pa.concat_arrays([found.flatten(), others]))
        values = self._values(pieces.to_numpy(zero_copy_only=False).tolist())
        # ids of the different pieces, of the different chunks, of all chunks; ``upto`` is where those before each end
        size = np.array([len(v) // 4 for v in values], dtype=np.int64)
        pool = laid(np.frombuffer(b"".join(values), dtype="<u4"), np.cumsum(size) - size, size, which)
        upto = np.concatenate([[0], np.cumsum(size[which])])[np.concatenate([[0], np.cumsum(parts)])]
        index = np.concatenate([index, more + (len(parts) - len(others))])
        raw = laid(pool, upto[:-1], np.diff(upto), index).tobytes()
        upto = np.concatenate([[0], np.cumsum(np.diff(upto)[index])])[np.concatenate([[0], np.cumsum(many)])] * 4
        out = [b""] * len(texts)
        for k, a, b in zip([*np.flatnonzero(~uneven), *np.flatnonzero(uneven)], upto[:-1].tolist(), upto[1:].tolist()):
            out[k] = raw[a:b]
        return out


def encoder(path: str) -> Encoder:
    """This Python process's encoder of a file; the tasks that a worker runs one after another share it."""
    held = sys.modules.setdefault("_plumbline_encoders", types.ModuleType("_plumbline_encoders"))
    if not hasattr(held, "by_path"):
        held.by_path = {}
    if path not in held.by_path:
        held.by_path = {path: Encoder(path)}
    return held.by_path[path]


def limited(texts, most: int = 2_000_000):
    """Slices of an Arrow column ``texts`` of about ``most`` characters, so that a batch's chunks stay bounded."""
    part, size = [], 0
    for t in texts:
        part.append(t.as_py())
        size += len(part[-1])
        if size >= most:
            yield part
            part, size = [], 0
    if part:
        yield part


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
