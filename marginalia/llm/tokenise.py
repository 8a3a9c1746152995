"""Token ids of whole texts, fast: texts are cut into words, digits and runs of signs as arrays, and each distinct one of a batch is looked up once."""

from __future__ import annotations

import os
import re
import unicodedata
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Entries of a worker's two tables together unless the caller names another number, misses (in tables) after which they start anew, and the longest chunk or
#: piece, in characters, that is kept.
CACHE, RENEWAL, LONGEST = 1_000_000, 20, 64

#: Chunks that are encoded as one text; characters of texts that are cut at a time.
LOT, AT_ONCE = 400, 400_000

# Plain characters fall into words, single digits and runs of signs whatever their case; each stands for itself.
_PLAIN = [c for c in map(chr, range(256)) if "\x21" <= c <= "\x7e" or c >= "\xa1"]
_ODD = re.compile(r"(?<![^ \n])[^ \n]*(?:[^\n\x20-\x7e\xa1-\xff]|<\|)[^ \n]*")  # a piece with other characters, or the sign of a special token
_HOLE = b"\1"  # stands where an odd piece was
_SPACE, _LETTER, _NUMBER, _SIGN, _ALONE = range(5)


def _kind(c: str) -> int:
    return _ALONE if c == "\1" else {"L": _LETTER, "N": _NUMBER}.get(unicodedata.category(c)[0], _SIGN) if c in _PLAIN else _SPACE


_LOWER = bytes(ord(c.lower()) if c in _PLAIN else i for i, c in enumerate(map(chr, range(256))))
_KIND = bytes(_kind(chr(i)) for i in range(256))
_KNOWN = "".join([*_PLAIN, " \n"]).encode("latin-1")


def default_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _firsts(low: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Where a word, a digit, a run of signs, a contraction or white space begins."""
    first = np.empty(len(low), bool)
    first[:1] = True
    np.not_equal(kind[1:], kind[:-1], out=first[1:])
    first |= (kind == _NUMBER) | (kind == _ALONE)
    signs = np.flatnonzero((low[:-1] == ord("'")) & first[:-1] & (kind[1:] == _LETTER))  # 's, 't, 're, 've, 'm, 'll, 'd
    one, two = low[signs + 1], low[np.minimum(signs + 2, len(low) - 1)]
    short = np.isin(one, list(b"stmd"))
    long = np.isin(one.astype(np.int64) * 256 + two, [a * 256 + b for a, b in (b"re", b"ve", b"ll")]) & (signs + 2 < len(low))
    for which, n in ((short, 2), (long, 3)):
        at = signs[which]
        first[at + 1] = False
        after = at[at + n < len(low)] + n
        first[after[kind[after] == _LETTER]] = True
    return first


class WordTokeniser:
    """ids(texts): little-endian uint32 ids of each text, equal to those of the vocabulary file's own tokenizer.

    For vocabularies that drop white space and never join what it separates. Plain text is cut into chunks: words, digits, runs
    of signs. Pieces between spaces with other than Latin-1 characters, or with the sign of a special token, go to the tokenizer whole.
    """

    def __init__(self, path: str, entries: int | None = None) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.merges = Tokenizer(self.tokenizer.model)  # for chunks in lower case, in signs that stand for their bytes
        self.merges.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.signs = {ord(c): self.tokenizer.pre_tokenizer.pre_tokenize_str(c)[0][0] for c in _PLAIN if c > "\x7e"}
        self.chunks: dict[bytes, bytes] = {_HOLE: b""}
        self.pieces: dict[str, bytes] = {}
        self.missed, self.entries = 0, entries
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def _encode(self, chunks: list[bytes]) -> list[bytes]:
        """The ids of each chunk; many are encoded as one text, which parts at their last tokens."""
        out, text = [], lambda x: b" ".join(x).decode("latin-1").translate(self.signs)
        lots = [chunks[i : i + LOT] for i in range(0, len(chunks), LOT)]
        for lot, e in zip(lots, self.merges.encode_batch_fast([text(x) for x in lots], add_special_tokens=False)):
            ids = np.array(e.ids, dtype="<u4")
            ends = ((np.flatnonzero(self.ends_word[ids]) + 1) * 4).tolist()
            if len(ends) == len(lot):
                raw = ids.tobytes()
                out += [raw[a:b] for a, b in zip([0, *ends], ends)]
            else:
                out += [np.array(x.ids, dtype="<u4").tobytes() for x in self.merges.encode_batch_fast([text([w]) for w in lot], add_special_tokens=False)]
        return out

    def _whole(self, pieces: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]

    def _found(self, words: list, table: dict, encode: Callable[[list], list[bytes]]) -> list[bytes]:
        """The ids of each of ``words``; short unseen ones are kept while there is room.

        Frequent ones come early, so a full table keeps serving most of a text; both start anew once they have missed
        many times their own size, as when the language of the texts changes.
        """
        found = list(map(table.get, words))
        unseen = [k for k, b in enumerate(found) if b is None]
        new = [words[k] for k in unseen]
        out, most = encode(new), self.entries or CACHE
        for k, b in zip(unseen, out):
            found[k] = b
        self.missed += len(new)
        if self.missed > RENEWAL * most:
            self.chunks.clear()
            self.pieces.clear()
            self.chunks[_HOLE], self.missed = b"", len(new)
        if (room := most - len(self.chunks) - len(self.pieces)) > 0:
            table.update([(w, b) for w, b in zip(new, out) if len(w) <= LONGEST][:room])
        return found

    def flat(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, one after the other, and where each text's begin, with the end of the last."""
        lengths = np.array([len(x or "") for x in texts], np.int64)
        joined, odd = "\n".join([x or "" for x in texts]), []
        try:
            raw = joined.encode("latin-1")
        except UnicodeEncodeError:
            raw = b"\0"
        if b"<|" in raw or raw.translate(None, _KNOWN):
            raw = _ODD.sub(lambda m: odd.append(m[0]) or "\1" + " " * (len(m[0]) - 1), joined).encode("latin-1")
        raw = raw.translate(_LOWER)
        low, kind = np.frombuffer(raw, np.uint8), np.frombuffer(raw.translate(_KIND), np.uint8)
        at = np.flatnonzero(_firsts(low, kind))
        ends, solid = np.append(at[1:], len(low)), kind[at] != _SPACE
        at, ends = at[solid], ends[solid]
        bounds = np.concatenate([[0], np.cumsum(ends - at)])
        chunks = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(bounds), pa.py_buffer(low[kind != _SPACE])])
        coded = chunks.dictionary_encode()
        words, which = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
        found = self._found(words, self.chunks, self._encode)
        if odd:
            number = {w: k for k, w in enumerate(dict.fromkeys(odd), len(words))}
            which = which.copy()
            which[which == words.index(_HOLE)] = [number[w] for w in odd]
            found += self._found(list(number), self.pieces, self._whole)
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        n = sizes[which]
        upto = np.concatenate([[0], np.cumsum(n)])
        from_ = np.repeat((np.cumsum(sizes) - sizes)[which] - upto[:-1], n) + np.arange(upto[-1])
        begins = np.searchsorted(at, np.cumsum(lengths + 1) - lengths - 1)
        return np.frombuffer(b"".join(found), "<u4")[from_], upto[np.append(begins, len(at))]

    def batches(self, texts: Sequence[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """``flat`` of some texts after the other, of a bounded number of characters unless one has more."""
        a = total = 0
        for b, x in enumerate(texts):
            total += len(x or "")
            if total > AT_ONCE and b > a:
                yield self.flat(texts[a:b])
                a, total = b, len(x or "")
        if a < len(texts):
            yield self.flat(texts[a:])

    def ids(self, texts: Sequence[str | None]) -> list[bytes]:
        return [ids[a:b].tobytes() for ids, at in self.batches(texts) for a, b in zip(at.tolist(), at[1:].tolist())]


@lru_cache(maxsize=2)
def word_tokeniser(path: str, entries: int | None = None) -> WordTokeniser:
    return WordTokeniser(path, entries)
