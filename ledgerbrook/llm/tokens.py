"""Token ids of whole texts by a public tokenizer."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np

from .common import KEPT

#: The last id of every document.
END = b"\0\0\0\0"
#: Texts are encoded together up to about so many bytes.
TOGETHER = 2 << 20
#: What ends a word in the vocabulary, and the byte that stands for it here.
SUFFIX, STOP = "</w>", b"\0"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_letters() -> dict[str, int]:
    """How byte-level vocabularies write bytes: printable ones as themselves, the others as the characters from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def word_ranks(vocabulary: dict[str, int], special: set[str]) -> dict[bytes, int] | None:
    """The vocabulary as merge ranks of bytes, a word's end as one more byte; None where it isn't such a vocabulary.

    Ids of a trained vocabulary are in the order of its merges, and two neighbours merge at the rank of what they spell:
    whatever lower ranks have left of a stretch doesn't depend on its surroundings, so no other pair can spell it.
    """
    byte, ranks = byte_letters(), {}
    for token, i in vocabulary.items():
        if token in special:
            continue
        body = token.removesuffix(SUFFIX)
        if not all(c in byte for c in body):
            return None
        raw = bytes(byte[c] for c in body) + (STOP if token != body else b"")
        if raw in ranks:
            return None
        ranks[raw] = i
    if any(bytes([b]) not in ranks or bytes([b]) + STOP not in ranks for b in range(256)):
        return None
    return ranks


class Encoder:
    """Texts -> ids as little-endian uint32 bytes, equal to the tokenizer's own ids of each whole text.

    The tokenizer drops white space and no token crosses it, so the pieces between ASCII white space are encoded apart
    and remembered, at most about `most` at a time. Nor does a token cross from letters to a full stop or comma. New words
    of letters alone are encoded many at once, by merge ranks that know a word's end; all others by the tokenizer itself.
    """

    def __init__(self, path: str, most: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer, self.most, self.seen = Tokenizer.from_file(path), most, {}
        ranks = word_ranks(self.tokenizer.get_vocab(), {t.content for t in self.tokenizer.get_added_tokens_decoder().values()})
        self.words = ranks and tiktoken.Encoding("words", pat_str=r"[^\x00]+\x00", mergeable_ranks=ranks, special_tokens={})
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), dtype=bool)
        self.ends[[i for raw, i in (ranks or {}).items() if raw.endswith(STOP)]] = True

    def _apart(self, words: list[str]) -> None:
        for w, e in zip(words, self.tokenizer.encode_batch(words, add_special_tokens=False), strict=True):
            self.seen[w.encode()] = np.array(e.ids, dtype="<u4").tobytes()

    def _letters(self, words: list[bytes]) -> None:
        """Words of letters only; of those that aren't ASCII, letters up to U+024F that keep their length in lower case."""
        if not words:
            return
        if self.words is None:
            return self._apart([w.decode() for w in words])
        ids = self.words.encode_to_numpy(b"\0".join([*words, b""]).decode().lower()).astype("<u4", copy=False)
        ends = np.flatnonzero(self.ends[ids]) + 1
        data = ids.tobytes()
        cuts = (4 * ends).tolist()
        self.seen.update(zip(words, [data[a:z] for a, z in zip([0, *cuts[:-1]], cuts, strict=True)], strict=True))

    def _learn(self, pieces: set[bytes]) -> None:
        seen, words, others, marked = self.seen, [], [], []
        for p in pieces:
            if p.isalpha():  # ASCII
                words.append(p)
                continue
            mark, body = p[-1:], p[:-1]
            if not (mark in (b".", b",") and body):
                mark, body = b"", p
            if not body.isalpha():
                s = body.decode()
                if not s.isalpha() or max(s) > "ɏ" or len(s.lower()) != len(s):
                    others.append(p.decode())
                    continue
            if mark:
                marked.append((p, body, mark))
                if body in seen or body in pieces:
                    continue
            words.append(body)
        self._letters(list(set(words)))
        self._apart(others + [m for m in (".", ",") if m.encode() not in seen])
        for p, body, mark in marked:
            seen[p] = seen[body] + seen[mark]

    def _together(self, pieces: list[list[bytes]]) -> Iterator[bytes]:
        if len(self.seen) > self.most:
            self.seen.clear()
        get = self.seen.get
        found = [list(map(get, own)) for own in pieces]
        gaps = [i for i, ids in enumerate(found) if None in ids]
        self._learn({p for i in gaps for p, ids in zip(pieces[i], found[i], strict=True) if ids is None})
        for i in gaps:
            found[i] = [get(p) if ids is None else ids for p, ids in zip(pieces[i], found[i], strict=True)]
        yield from map(b"".join, found)

    def __call__(self, texts: list[bytes | None]) -> Iterator[bytes]:
        """The ids of each text, in order; null has none."""
        held, size = [], 0
        for text in texts:
            held.append(text.split() if text else [])
            size += len(text or b"")
            if size >= TOGETHER:
                yield from self._together(held)
                held, size = [], 0
        yield from self._together(held)


def encoder(path: str) -> Encoder:
    """One encoder for each file and worker process, until a task of another kind needs the memory (`released`)."""
    if path not in KEPT:
        KEPT[path] = Encoder(path)
    return KEPT[path]
