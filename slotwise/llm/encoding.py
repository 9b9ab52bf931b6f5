"""Token ids of whole texts: by the library itself, or through a bounded vocabulary of the words that a worker has met.

Byte-level BPE splits a text before every single space between two visible characters, and a piece tokenizer
whose pieces hold a space at their beginning only is split before every space that a visible character precedes;
so both give a text's ids as those of its words, each with the space before it, one after another. Words that
the vocabulary lacks are encoded together, many in one call, and their tokens told apart by their lengths in bytes. For byte-level BPE whose ids are the ranks of its merges, words of characters
that every Unicode version classes alike go through tiktoken, which gives the same ids from the same vocabulary,
sooner. Tokenizers of other kinds get whole texts.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Hashable, Sequence
from itertools import chain, compress

import numpy as np

from slotwise.llm.token_counts import _LETTERS

MEMO, CHUNK = 150_000, 512
_RUN = re.compile(r"\s\s")
_CUT = re.compile(r"(?<=\S) (?=\S)")
#: ASCII and the Latin letters of Europe: one class each in all versions of Unicode.
_SETTLED = re.compile(r"[\x00-\x7F\u00A0-\u024F]*")
#: A word of such characters between visible ones.
_PLAIN = re.compile(r"(?!\s)[\x00-\x7F\u00A0-\u024F]+(?<!\s)")
# Fixed value: how byte-level BPE of this kind splits a text.
_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def words_of(text: str) -> list[str]:
    """The text cut at every single space between two visible characters."""
    if _RUN.search(text) or text[:1].isspace() or text[-1:].isspace():
        return _CUT.split(text)
    return text.split(" ")


def plain(word: str) -> bool:
    """Whether a word is settled characters between visible ones, without any space."""
    return bool(_PLAIN.fullmatch(word)) and word.split() == [word]


def told_apart(words: list[str], plain: int, encode: Callable[[str], list[int]], lengths: np.ndarray, bytes_of: dict[int, bytes], spell: bool) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the words one after another, and how many each has; with ``spell`` the one id -1 for a word that its tokens do not spell.

    The first ``plain`` words are encoded ``CHUNK`` at a time: one after another they are a text that is split before each of them.
    """
    of = bytes_of.__getitem__
    found: list[np.ndarray] = [np.empty(0, np.int32)]
    counts: list[np.ndarray] = [np.empty(0, np.int64)]

    def one_by_one(some: list[str]) -> None:
        ids = list(map(encode, some))
        if spell:
            ids = [x if b"".join(map(of, x)) == w.encode() else [-1] for x, w in zip(ids, some, strict=True)]
        found.append(np.fromiter(chain.from_iterable(ids), np.int32))
        counts.append(np.fromiter(map(len, ids), np.int64, len(ids)))

    for at in range(0, plain, CHUNK):
        some = words[at : min(at + CHUNK, plain)]
        text = "".join(some)
        raw, ids = text.encode(), encode(text)
        if b"".join(map(of, ids)) != raw:  # also where it is not asked for: lengths are to tell the words apart
            one_by_one(some)
            continue
        whole = np.array(ids, np.int32)
        ends = np.cumsum(list(map(len, some if len(raw) == len(text) else [w.encode() for w in some])))
        found.append(whole)
        counts.append(np.diff(np.searchsorted(np.cumsum(lengths[whole]), ends) + 1, prepend=0))
    one_by_one(words[plain:])
    return np.concatenate(found), np.concatenate(counts)


class BytePairs:
    """A byte-level BPE tokenizer from its JSON file. ``plain``: special strings inside texts are ordinary text."""

    def __init__(self, content: bytes, *, plain: bool = False) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_buffer(content)
        self._tokenizer.no_truncation()
        self._tokenizer.no_padding()
        self._tokenizer.encode_special_tokens = plain
        said = json.loads(content)
        before, added = said.get("pre_tokenizer") or {}, said.get("added_tokens", [])
        self.marks = [] if plain else [t["content"] for t in added]
        odd = any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") or " " in t["content"] for t in added)
        self.splits = said.get("normalizer") is None and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not odd
        self._quick = self._ranked(said) if self.splits else None
        letters = {chr(c): b for b, c in ((b, ord(x)) for b, x in _LETTERS.items())}
        special = {t["id"]: t["content"].encode() for t in added}
        #: The bytes of each id.
        self.bytes_of = {i: special[i] if i in special else bytes(letters[c] for c in word) for word, i in self._tokenizer.get_vocab(with_added_tokens=True).items() if i in special or all(c in letters for c in word)}

    @staticmethod
    def _ranked(said: dict):
        """The same vocabulary as ranks, where ids follow the order of the merges; else None."""
        import tiktoken

        letters = {c: b for b, c in _LETTERS.items()}
        model = said["model"]
        special = {t["content"] for t in said.get("added_tokens", [])}
        vocab = {word: i for word, i in model["vocab"].items() if word not in special}
        made = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model["merges"]]
        plain = not model.get("dropout") and not model.get("unk_token") and not model.get("continuing_subword_prefix") and not model.get("end_of_word_suffix") and not model.get("ignore_merges")
        if not plain or len(vocab) != 256 + len(made) or any(vocab.get(m) != 256 + k for k, m in enumerate(made)) or not all(c in letters for w in vocab for c in w):
            return None
        ranks = {bytes(letters[c] for c in word): i for word, i in vocab.items()}
        return tiktoken.Encoding("ranks", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})

    def whole(self, texts: list[str]) -> list[list[int]]:
        """Ids of whole texts, of each at once where that is the sooner way, else word by word."""
        quick = self._quick is not None
        return [self._quick.encode_ordinary(t) if quick and _SETTLED.fullmatch(t) and not any(m in t for m in self.marks) else self._by_words(t) for t in texts]

    def _by_words(self, text: str) -> list[int]:
        """Ids of a text; words of settled characters in one call from one unsettled word to the next."""
        if not self.splits:
            return self.ids(text)
        first, *later = words_of(text)
        runs = [[first]]
        settled = bool(_SETTLED.fullmatch(first))
        for word in later:
            now = bool(_SETTLED.fullmatch(word))
            if now and settled:
                runs[-1].append(" " + word)
            else:
                runs.append([" " + word])
            settled = now
        return list(chain.from_iterable(self.ids("".join(r)) for r in runs))

    def ids(self, text: str) -> list[int]:
        """Ids of a text or of a word with what stands before it."""
        if self._quick is not None and _SETTLED.fullmatch(text) and not any(m in text for m in self.marks):
            return self._quick.encode_ordinary(text)
        return self._tokenizer.encode(text, add_special_tokens=False).ids


class Pieces:
    """A sentencepiece tokenizer that puts a space before every text, from its model file."""

    def __init__(self, content: bytes) -> None:
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self._model = sentencepiece.SentencePieceProcessor(model_proto=content)
        said = sentencepiece_model_pb2.ModelProto()
        said.ParseFromString(content)
        normal = said.normalizer_spec
        words = [p.piece for p in said.pieces]
        #: Whether words may be encoded one by one.
        self.splits = not normal.precompiled_charsmap and normal.add_dummy_prefix and not normal.remove_extra_whitespaces and said.trainer_spec.model_type == 2 and not any("▁" in w.lstrip("▁") for w in words) and not any(p.type == 4 for p in said.pieces)
        self.bytes_of = {i: bytes([int(w[3:5], 16)]) if p.type == 6 else w.replace("▁", " ").encode() for i, (w, p) in enumerate(zip(words, said.pieces, strict=True))}

    def ids(self, text: str) -> list[int]:
        """Ids of a text that begins with a space, which the tokenizer puts there by itself."""
        return self._model.encode(text[1:])


class Vocabulary:
    """The tokens of the words met so far, as runs of one array of ids for each tokenizer.

    Words behind a space and words that begin a text are told apart. With ``spell`` a word whose tokens are not its bytes
    has the one id -1. The words of ``keep``, each behind a space, have the first numbers and are never given up.
    """

    def __init__(self, tokenizers: list[BytePairs | Pieces], *, spell: bool) -> None:
        self.tokenizers, self.spell = tokenizers, spell
        self.splits = all(t.splits for t in tokenizers)
        #: Bytes of each id; the last entry is that of id -1.
        self.lengths = [np.array([*(len(t.bytes_of.get(i, b"")) for i in range(max(t.bytes_of) + 1)), 0], np.int32) for t in tokenizers]
        self.keep([])

    def keep(self, often: Sequence[str]) -> None:
        """Begin again with these words for ``often``, unless they are so already."""
        if getattr(self, "_kept", None) == list(often):
            return
        self._kept = list(often)
        self._often: tuple = {}, [np.empty(0, np.int32) for _ in self.tokenizers], [np.zeros(1, np.int64) for _ in self.tokenizers]
        self._clear()
        if often:
            self._numbers(self.later, self._kept, " ")
            self._often = dict(self.later), self.ids, self.start

    def _clear(self) -> None:
        self.later: dict[str, int] = dict(self._often[0])
        self.first: dict[str, int] = {}
        self.ids, self.start = list(self._often[1]), list(self._often[2])

    def _numbers(self, known: dict[str, int], words: list[str], before: str) -> np.ndarray:
        """The numbers of the words, after those that are new have been encoded."""
        if new := [w for w in dict.fromkeys(words) if w not in known]:
            ready = [bool(self.splits and before and _PLAIN.fullmatch(w)) for w in new]
            plain = sum(ready)
            new = [*compress(new, ready), *(w for w, r in zip(new, ready, strict=True) if not r)]
            have = len(self.start[0]) - 1
            known.update(zip(new, range(have, have + len(new)), strict=True))
            spaced = [before + w for w in new]
            for k, (tokenizer, lengths) in enumerate(zip(self.tokenizers, self.lengths, strict=True)):
                ids, counts = told_apart(spaced, plain, tokenizer.ids, lengths, tokenizer.bytes_of, self.spell)
                self.ids[k] = np.concatenate([self.ids[k], ids])
                self.start[k] = np.concatenate([self.start[k], self.start[k][-1] + np.cumsum(counts)])
        return np.fromiter(map(known.__getitem__, words), np.int64, len(words))

    def numbers(self, texts: list[str], *, spaced: bool) -> tuple[np.ndarray, np.ndarray]:
        """How many words each text has, and the numbers of all. ``spaced``: a space is put before every text that is not empty."""
        if not self.splits or len(self.start[0]) - len(self._often[0]) > MEMO:
            self._clear()
        parts = [(words_of(t) if self.splits else [t]) if t else [] for t in texts]
        words = np.fromiter(map(len, parts), np.int64, len(parts))
        number = np.empty(int(words.sum()), np.int64)
        begins = np.zeros(len(number), bool)
        if not spaced:
            begins[(np.cumsum(words) - words)[words > 0]] = True
            number[begins] = self._numbers(self.first, [p[0] for p in parts if p], "")
        number[~begins] = self._numbers(self.later, list(chain.from_iterable(p if spaced else p[1:] for p in parts)), " ")
        return words, number

    def counts(self) -> list[np.ndarray]:
        """For each tokenizer: how many tokens the word of each number has."""
        return [np.diff(start) for start in self.start]

    def tokens(self, number: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each tokenizer: how many tokens each word has, given by its number until the next call of ``numbers``, and the ids of all."""
        out = []
        for ids, start in zip(self.ids, self.start, strict=True):
            first = start[number]
            n = start[number + 1] - first
            at = np.arange(int(n.sum())) + np.repeat(first - (np.cumsum(n) - n), n)
            out.append((n, ids[at]))
        return out

    def encode(self, texts: list[str], *, spaced: bool) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each tokenizer: how many tokens each text has, and the ids of all. ``spaced`` as in ``numbers``."""
        words, number = self.numbers(texts, spaced=spaced)
        owner = np.repeat(np.arange(len(texts)), words)
        return [(np.bincount(owner, n, len(texts)).astype(np.int64), ids) for n, ids in self.tokens(number)]


_shared: dict[Hashable, object] = {}


def shared[T](key: Hashable, make: Callable[[], T]) -> T:
    """What ``make`` gives for a key, one a worker, which keeps it from task to task; that of another key is given up."""
    if key not in _shared:
        _shared.clear()
        _shared[key] = make()
    return _shared[key]
