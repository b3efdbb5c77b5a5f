"""BPE with word ends over lower-cased words, white space dropped: ids of the
word_bpe_49k.json vocabulary as the tokenizers library gives them.

White space separates words for good, so a text's ids are its chunks' ids in
order. Chunks of ASCII print and Latin-1 letters are normalised and merged
here, as arrays; all others go to the library by themselves.
"""

from __future__ import annotations

import json
import re

import numpy as np

from quarry.llm import byte_bpe
from quarry.llm.bpe_codec import runs_of_bytes
from quarry.llm.common import vocabulary

#: Whether a character is plain; all beyond Latin-1 are not.
_PLAIN = np.array([c == 10 or 33 <= c <= 126 or (192 <= c <= 255 and c not in (215, 247)) for c in range(257)])
#: Fixed: the vocabulary's pre-tokens, for plain chunks after lower-casing, and line ends between chunks.
_PRETOKEN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|\n|[^a-zß-öø-ÿ0-9\n]+")
#: Characters at which Python splits words but the vocabulary doesn't, and runs of the others.
_SEPARATORS = re.compile("[\x1c-\x1f]")
_CHUNK = re.compile(r"[\S\x1c-\x1f]+")


def _other(chunks: list[str]) -> list[int]:
    """Which chunks hold other characters, or could hold a special string."""
    code = np.frombuffer("\n".join(chunks).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    bad = ~_PLAIN[np.minimum(code, 256)]
    bad[:-1] |= (code[:-1] == ord("<")) & (code[1:] == ord("|"))
    lines = np.flatnonzero(code == 10)
    return np.unique(np.searchsorted(lines, np.flatnonzero(bad))).tolist()


class WordCodec(byte_bpe.FragmentTable):
    """encode(texts) -> arrays of ids, as encode(..., add_special_tokens=False)."""

    def __init__(self, name: str, cache: int = byte_bpe.CACHE):
        from tokenizers import Tokenizer

        path = vocabulary(name)
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        chars = byte_bpe.byte_chars()
        self.inner = np.array([vocab[chars[b]] for b in range(256)], dtype=np.int64)
        self.last = np.array([vocab[chars[b] + end] for b in range(256)], dtype=np.int64)
        merges = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            merges.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
        self.dtype = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")
        self.merger = byte_bpe.RankMerger(self.library.get_vocab_size(), merges)
        super().__init__({}, cache)

    def split(self, text: str) -> list[str]:
        return _CHUNK.findall(text) if _SEPARATORS.search(text) else text.split()

    def learn(self, fragments: list[str]) -> list[bytes]:
        other = {k: self.library.encode(fragments[k], add_special_tokens=False).ids for k in _other(fragments)}
        plain = [x for k, x in enumerate(fragments) if k not in other] if other else fragments
        # all plain chunks as one string, a line each
        text = "\n".join(plain).lower()
        flat = np.frombuffer(text.encode(), dtype=np.uint8)
        if not len(flat):
            return [np.array(other[k], dtype=self.dtype).tobytes() for k in range(len(fragments))]
        ends = np.cumsum(np.fromiter(map(len, _PRETOKEN.findall(text)), dtype=np.int64))
        begins = np.append(np.flatnonzero((flat & 0xC0) != 0x80), len(flat))  # of characters
        ends = begins[ends]
        symbols = self.inner[flat]
        symbols[ends - 1] = self.last[flat[ends - 1]]
        inside = flat != 10
        line_of = np.cumsum(flat[ends - 1] == 10)
        ids, of = self.merger.merge(symbols[inside], np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))[inside])
        out = runs_of_bytes(ids.astype(self.dtype), line_of[of], len(plain))
        for k in sorted(other):
            out.insert(k, np.array(other[k], dtype=self.dtype).tobytes())
        return out

    def encode(self, batch: list[str | None]) -> list[np.ndarray]:
        return [np.frombuffer(b"".join(found), dtype=self.dtype) for found in self.resolve(batch)]


def codec(name: str) -> WordCodec:
    """One codec for each vocabulary and worker."""
    return byte_bpe.table_of((WordCodec, name), lambda: WordCodec(name))
