"""Token ids of whole texts by a public vocabulary, one look-up per white-space piece.

The vocabulary's rules drop white space and never join across it, so the ids of a text are the ids of
its pieces in order. Where ASCII letters, digits and signs meet the rules cut as well (but for an apostrophe before a
letter), so pieces end there too and `word,` and `Word` share one entry. Each task keeps the pieces it has met; only new ones reach the library's model.
A vocabulary whose rules do look across white space (byte-level BPE with leading spaces, sentencepiece)
is encoded by whole text instead: `splits` says which holds.
"""

from __future__ import annotations

import json
import os
from functools import lru_cache

import numpy as np

from .textkit import RAW_TABLE, WHITE_TABLE, Block, distinct, gather, words

#: The rules under which pieces between white space are independent (fixed values of the public file format).
_WORD_PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
_NORMALIZERS = {"NFC", "Lowercase", "Replace"}
#: Letters 1, digits 2, other visible ASCII 3; white space and what is beyond ASCII 0: there pieces are not cut.
_KIND = np.zeros(256, np.uint8)
_KIND[33:127] = 3
_KIND[[*range(48, 58)]] = 2
_KIND[[*range(65, 91), *range(97, 123)]] = 1


def kind_changes(data: np.ndarray) -> np.ndarray:
    """Marks bytes whose kind differs from the kind of the byte before; not a letter after an apostrophe, which may be one pre-token."""
    kind, out = _KIND[data], np.zeros(len(data), bool)
    a, b = kind[:-1], kind[1:]
    out[1:] = (a != b) & (a > 0) & (b > 0) & ((data[:-1] != ord("'")) | (b != 1))
    return out


class Recent:
    """A store of at most `keep` entries that forgets the least recently used ones first, half of it at a time."""

    def __init__(self, keep: int) -> None:
        self.half, self.new, self.old = max(1, keep // 2), {}, {}

    def get(self, keys: list) -> list:
        """The value of each key, None where it is not held."""
        found = list(map(self.new.get, keys))
        if self.old:
            again = self.old.get
            moved = {k: v for k, x in zip(keys, found) if x is None and (v := again(k)) is not None}
            if moved:
                found = [moved.get(k) if x is None else x for k, x in zip(keys, found)]
                self.put(moved)
        return found

    def put(self, more: dict) -> None:
        if len(self.new) + len(more) > self.half:
            self.old, self.new = self.new, {}
        self.new.update(more)


class Encoder:
    """Ids of texts as the tokenizers library gives them without added special tokens.

    `keep` bounds the pieces and the pre-tokens held in memory; it costs time, not results.
    """

    def __init__(self, path: str, keep: int = 200_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            rules = json.load(f)
        self.special = [t["content"].encode() for t in rules.get("added_tokens", [])]
        self.mark = os.path.commonprefix(self.special) or (b"" if self.special else b"\xff")  # no text holds byte 255
        self.splits = self._splits(rules) and not any(set(s) & set(b" \t\n\r\x0b\x0c") for s in self.special)
        self.size = self.tokenizer.get_vocab_size()
        self.dtype = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self.pieces, self.words = Recent(keep), Recent(keep)
        if self.splits:
            import regex

            self._find = regex.compile(_WORD_PATTERN).findall
            self._plain = regex.compile(r"[\x21-\x7e\xa1-\xff]+").fullmatch
            keep_byte = [*range(33, 127), *range(161, 173), *range(174, 256)]
            names = dict.fromkeys(keep_byte)
            others = [b for b in range(256) if b not in names]
            self._byte = [chr(b) if b in names else chr(256 + others.index(b)) for b in range(256)]

    @staticmethod
    def _splits(rules: dict) -> bool:
        normal = rules.get("normalizer") or {}
        steps = normal.get("normalizers", [normal])
        pre = (rules.get("pre_tokenizer") or {}).get("pretokenizers", [])
        pattern = pre[0].get("pattern", {}).get("Regex") if pre else None
        flags = any(t.get(k) for t in rules.get("added_tokens", []) for k in ("single_word", "lstrip", "rstrip", "normalized"))
        replaced = all(s.get("pattern") == {"Regex": "\\s+"} and s.get("content") == " " for s in steps if s.get("type") == "Replace")
        kinds = {s.get("type") for s in steps}
        return rules["model"]["type"] == "BPE" and kinds <= _NORMALIZERS and "Lowercase" in kinds and replaced and pattern == _WORD_PATTERN and pre[0].get("invert") is True and not flags

    def _library(self, text: str) -> bytes:
        return self._pack(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _pack(self, ids: list[int]) -> bytes:
        return np.array(ids, self.dtype).tobytes()

    def _parts(self, piece: bytes) -> list[bytes] | None:
        """The pre-tokens of a piece, lower case; None where only the library's own tables tell."""
        if piece.isalpha():  # ASCII letters alone are one pre-token
            return [piece.lower()]
        if piece[:-1].isalpha() and piece[-1] in b".,;:!?|)":
            return [piece[:-1].lower(), piece[-1:]]
        text = piece.decode("utf-8", "replace")
        plain = text.isprintable() if piece.isascii() else self._plain(text)
        if not plain or (self.mark in piece and any(s in piece for s in self.special)):
            return None  # beyond Latin-1 composing and lower case follow tables of their own
        return [w.encode() for w in self._find(text.lower())]

    def _tokenized(self, names: list[str]) -> list[bytes]:
        """Packed ids of pre-tokens in the model's own spelling."""
        tokenize, ids, at = self.tokenizer.model.tokenize, [], [0]
        for name in names:
            ids += [t.id for t in tokenize(name)]
            at.append(len(ids))
        flat, wide = self._pack(ids), self.dtype.itemsize
        return [flat[i * wide : j * wide] for i, j in zip(at, at[1:])]

    def learn(self, new) -> dict[bytes, bytes]:
        """Ids of pieces, each worked out once: ASCII letters alone are a pre-token, of the others the model sees every distinct pre-token."""
        alone = [p for p in new if p.isalpha()]
        out = dict(zip(alone, self._tokenized([p.decode("ascii").lower() for p in alone])))
        parts = {p: self._parts(p) for p in new if p not in out}
        every = list(dict.fromkeys([w for ws in parts.values() for w in ws or ()]))
        got, names = dict(zip(every, self.words.get(every))), self._byte
        fresh = [w for w in every if got[w] is None]
        more = dict(zip(fresh, self._tokenized([w.decode("ascii") if w.isascii() else "".join([names[b] for b in w]) for w in fresh])))
        self.words.put(more)
        got.update(more)
        out.update({p: self._library(p.decode("utf-8", "replace")) if ws is None else got[ws[0]] if len(ws) == 1 else b"".join([got[w] for w in ws]) for p, ws in parts.items()})
        return out

    def block(self, block: Block, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a block's documents one after another, each with the end id if one is given, and where each document starts.

        Every distinct piece of the block is looked up once; its ids are then dealt out to all its places.
        """
        if not self.splits:
            parts = [np.frombuffer(self._library(block.text(i).decode("utf-8", "replace")), self.dtype) for i in range(len(block.rows))]
            lengths = np.array([len(x) for x in parts], np.int64)
            flat = np.concatenate([*parts, np.zeros(0, self.dtype)])
        else:
            data = block.data.tobytes()
            if self.mark in data:  # special strings may stand in it: they are met in whole pieces, capitals kept
                starts, ends, hashes, first = words(block, RAW_TABLE)
            else:
                starts, ends, hashes, first = words(block, WHITE_TABLE, kind_changes(block.data))
                data = data.lower()  # ASCII alone, as the hashes
            one, number = distinct(hashes)
            pieces = [data[i:j] for i, j in zip(starts[one].tolist(), ends[one].tolist())]
            found = self.look_up(pieces)
            joined = np.frombuffer(b"".join(found), self.dtype)
            size = np.array([len(x) for x in found], np.int64) // self.dtype.itemsize
            at = np.cumsum(size) - size
            counts = size[number]
            flat = gather(joined, at[number], counts)
            upto = np.concatenate([[0], np.cumsum(counts)])
            lengths = upto[first[1:]] - upto[first[:-1]]
        offsets = np.concatenate([[0], np.cumsum(lengths)])
        if end_id is None:
            return flat, offsets
        out = np.empty(len(flat) + len(lengths), flat.dtype)
        places = offsets[1:] + np.arange(len(lengths))
        keep = np.ones(len(out), bool)
        keep[places] = False
        out[keep], out[places] = flat, end_id
        return out, offsets + np.arange(len(offsets))

    def look_up(self, pieces: list[bytes]) -> list[bytes]:
        """Packed ids of each piece; pieces not met before are learnt."""
        found = self.pieces.get(pieces)
        missing = [i for i, x in enumerate(found) if x is None]
        if missing:
            new = self.learn([pieces[i] for i in missing])
            for i in missing:
                found[i] = new[pieces[i]]
            self.pieces.put(new)
        return found


@lru_cache(maxsize=2)
def encoder(path: str, keep: int = 200_000) -> Encoder:
    """One encoder a worker process and file, kept from task to task."""
    return Encoder(path, keep)


class PieceCounter:
    """How many ids each of some distinct pieces gives, for .json (tokenizers) and .model (sentencepiece) vocabularies.

    `splits` tells whether the pieces between white space are independent, so that their counts add up.
    """

    def __init__(self, path: str) -> None:
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.splits = False
            self.counts = lambda texts: [len(model.encode(t.decode("utf-8", "replace"))) for t in texts]
        else:
            enc = encoder(path)
            self.splits, wide = enc.splits, enc.dtype.itemsize
            if self.splits:
                self.counts = lambda texts: [len(x) // wide for x in map(enc.learn(texts).get, texts)]
            else:
                self.counts = lambda texts: [len(enc._library(t.decode("utf-8", "replace"))) // wide for t in texts]


@lru_cache(maxsize=2)
def piece_counter(path: str) -> PieceCounter:
    return PieceCounter(path)
