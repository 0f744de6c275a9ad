"""Encoding of whole texts with a public tokenizer file, many texts at a time.

:class:`Encoder` gives for every text what the library gives for it.  For a ``tokenizers`` file whose pre-tokenizer drops
white space and cuts a text into letters, digits and other characters, the cut is made with numpy over a block of texts,
each distinct piece is encoded once by the library, and pieces seen before come from a bounded table.  Texts that this cut
doesn't cover (characters beyond Latin-1 letters, control characters, special strings) and other tokenizer files go to the
library whole.

``cuttable`` says whether a single space between an ASCII letter or digit and another always ends one piece and begins the
next, whatever else the text holds (:mod:`~.token_count` says why that is so for the files it holds for).
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from . import textscan as S

U = np.uint64
#: A piece table is emptied beyond so many pieces; it is a cache only.
MOST_PIECES = 400_000

#: How sentencepiece writes a space.
SPACE_MARK = "\u2581"

LETTER, DIGIT, OTHER, BLANK, BAD = range(5)
KIND = np.full(256, BAD, np.uint8)
KIND[[0x20, *range(0x09, 0x0E)]] = BLANK
KIND[0x21:0x7F] = OTHER
KIND[ord("0") : ord("9") + 1] = DIGIT
KIND[ord("a") : ord("z") + 1] = LETTER
KIND[ord("A") : ord("Z") + 1] = LETTER
KIND[0x80:0xC0] = LETTER  # the second byte of a Latin-1 letter
KIND[0xC3] = LETTER


class Encoder:
    def __init__(self, path: str):
        self.path = path
        self.pieces = None
        if path.endswith(".model"):
            import sentencepiece

            self.library = sentencepiece.SentencePieceProcessor(model_file=path)
            pieces = map(self.library.id_to_piece, range(self.library.get_piece_size()))
            self.cuttable = not any(SPACE_MARK in p.lstrip(SPACE_MARK) for p in pieces)
            return
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        by_regex = pre.get("type") == "ByteLevel" and pre.get("use_regex") and spec.get("normalizer") is None
        strips = any(x["lstrip"] or x["rstrip"] or " " in x["content"] for x in spec["added_tokens"])
        self.cuttable = bool(fits(spec) or by_regex) and spec["model"]["type"] == "BPE" and not spec["model"].get("dropout") and not strips
        if fits(spec):
            ends = np.zeros(max(self.library.get_vocab_size(True), max(spec["model"]["vocab"].values()) + 1), bool)
            ends[[i for w, i in spec["model"]["vocab"].items() if w.endswith("</w>")]] = True
            self.specials = [x["content"].encode() for x in spec["added_tokens"]]
            spec |= {"normalizer": None, "added_tokens": []}
            spec["pre_tokenizer"] = {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, spec["pre_tokenizer"]["pretokenizers"][1]]}
            self.pieces = Pieces(Tokenizer.from_str(json.dumps(spec)), ends)

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text, by the library alone."""
        if self.path.endswith(".model"):
            return self.library.encode(texts, num_threads=1)
        return [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def marked(self, col: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Of each text: its ids, and in bytes of the text where each token begins; -1 where a token goes on with a piece."""
        if self.pieces is not None:
            buf, offs = S.raw(col)
            odd = self.odd(buf, offs)
            ids, starts, begins = self.pieces.marked(buf, offs, ~odd)
        else:
            odd = np.ones(len(col), bool)
        for k in range(len(col)):
            if not odd[k]:
                yield ids[starts[k] : starts[k + 1]], begins[starts[k] : starts[k + 1]]
                continue
            text = col[k].as_py()
            if self.path.endswith(".model"):
                out = self.library.encode(text, out_type="proto").pieces
                at = np.fromiter((x.begin for x in out), np.int64, len(out))  # in bytes
                at[1:][at[1:] == at[:-1]] = -1
                yield np.fromiter((x.id for x in out), np.uint32, len(out)), at
            else:
                e = self.library.encode(text, add_special_tokens=False)
                code = np.frombuffer(text.encode("utf-32-le"), "<u4")
                size = S.segments(1 + (code > 0x7F).astype(np.int64) + (code > 0x7FF) + (code > 0xFFFF))
                at = size[np.fromiter((a for a, _ in e.offsets), np.int64, len(e.ids))]
                at[1:][at[1:] == at[:-1]] = -1
                yield np.array(e.ids, np.uint32), at

    def column(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a column end to end, and where each text's ids begin; null texts are empty."""
        if self.pieces is None:
            ids = self.encode(["" if x is None else x for x in col.to_pylist()])
            return np.fromiter((i for x in ids for i in x), np.uint32), S.segments(np.array([len(x) for x in ids], np.int64))
        buf, offs = S.raw(col)
        odd = self.odd(buf, offs)
        if not odd.any():
            return self.pieces.column(buf, offs)
        plain, starts = self.pieces.column(buf, offs, ~odd)
        rows = np.flatnonzero(odd)
        slow = self.encode([col[int(i)].as_py() for i in rows])
        counts = np.diff(starts)
        counts[rows] = [len(x) for x in slow]
        full = S.segments(counts)
        ids = np.empty(full[-1], np.uint32)
        place = np.ones(full[-1], bool)
        for i, x in zip(rows, slow, strict=True):
            ids[full[i] : full[i + 1]] = x
            place[full[i] : full[i + 1]] = False
        ids[place] = plain
        return ids, full

    def odd(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Texts that the numpy cut doesn't cover."""
        out = np.zeros(len(offs) - 1, bool)
        if not len(buf):
            return out
        bad = KIND[buf] == BAD
        lead = np.flatnonzero(buf == 0xC3)
        if len(lead):
            bad[lead] |= np.isin(buf[np.minimum(lead + 1, len(buf) - 1)], (0x97, 0xB7))  # the signs for times and divide
        out[S.owners(np.flatnonzero(bad), offs)] = True
        if (buf == ord("<")).any():
            data = buf.tobytes()
            for s in self.specials:
                at = data.find(s)
                while at >= 0:
                    i = int(S.owners(np.array([at]), offs)[0])
                    out[i] = True
                    at = data.find(s, int(offs[i + 1]))
        return out


def fits(spec: dict) -> bool:
    """Whether the numpy cut does what this file's normalizer and pre-tokenizer do."""
    norm, pre, model = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}, spec["model"]
    parts = pre.get("pretokenizers", [])
    return (
        [x["type"] for x in norm.get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
        and norm["normalizers"][1]["pattern"] == {"Regex": "\\s+"}
        and [x["type"] for x in parts] == ["Split", "ByteLevel"]
        and parts[0]["pattern"] == {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}
        and parts[0]["behavior"] == "Removed" and parts[0]["invert"] and not parts[1]["use_regex"] and not parts[1]["add_prefix_space"]
        and model["type"] == "BPE" and model.get("end_of_word_suffix") == "</w>" and not model.get("dropout")
        and spec.get("post_processor") is None
    )


class Pieces:
    """The numpy cut, and the table of encoded pieces."""

    def __init__(self, library, ends: np.ndarray):
        self.library, self.ends = library, ends
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, U)  # sorted hashes of pieces
        self.rank = np.zeros(0, np.int64)  # of each key, the piece's number
        self.ids, self.starts = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def cut(self, buf: np.ndarray, offs: np.ndarray, keep: np.ndarray | None):
        low = S.LOWER[buf]
        after = np.flatnonzero(buf[:-1] == 0xC3) + 1
        up = after[(buf[after] >= 0x80) & (buf[after] <= 0x9E)]
        low[up] += 0x20
        kind = KIND[low]
        if keep is not None:
            kind[~np.repeat(keep, np.diff(offs))] = BLANK
        begin = kind != BLANK
        change = np.empty(len(kind), bool)
        change[:1] = True
        change[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
        change[offs[:-1][offs[:-1] < len(kind)]] = True
        cuts = np.flatnonzero(change)
        lens = np.diff(np.append(cuts, len(kind)))
        real = begin[cuts]
        starts, ends = cuts[real], (cuts + lens)[real]
        lone = np.flatnonzero((low[starts] == 0x27) & (ends - starts == 1))
        lone = lone[lone + 1 < len(starts)]
        lone = lone[(starts[lone + 1] == ends[lone]) & (kind[starts[np.minimum(lone + 1, len(starts) - 1)]] == LETTER)]
        if len(lone):  # 's 't 'm 'd 're 've 'll belong to the quote
            owner = S.owners(starts, offs)
            lone = lone[owner[lone] == owner[lone + 1]]
            a = low[starts[lone + 1]]
            b = np.where(ends[lone + 1] - starts[lone + 1] > 1, low[np.minimum(starts[lone + 1] + 1, len(low) - 1)], 0)
            take = np.where(np.isin(a, [*b"stmd"]), 1, np.where((np.isin(a, [*b"rv"]) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l"))), 2, 0))
            ends[lone] += take
            starts[lone + 1] += take
            full = ends > starts
            starts, ends = starts[full], ends[full]
        return low, starts, ends

    def column(self, buf: np.ndarray, offs: np.ndarray, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        ids, total, starts = self._encode(buf, offs, keep)
        return ids, total[np.searchsorted(starts, offs, "left")]

    def marked(self, buf: np.ndarray, offs: np.ndarray, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As :meth:`column`, and of each token where in its text its piece begins, or -1 if it isn't a piece's first."""
        ids, total, starts = self._encode(buf, offs, keep)
        begins = np.full(len(ids), -1)
        begins[total[:-1]] = starts - offs[S.owners(starts, offs)]
        return ids, total[np.searchsorted(starts, offs, "left")], begins

    def _encode(self, buf: np.ndarray, offs: np.ndarray, keep: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all pieces end to end, where each piece's ids begin, where each piece begins."""
        low, starts, ends = self.cut(buf, offs, keep)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(1, np.int64), starts
        h = S.hash_spans(low, starts, ends)
        keys, first, back = np.unique(h, return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        if len(self.keys):
            known = self.keys[np.minimum(at, len(self.keys) - 1)] == keys
        if not known.all():
            if len(self.keys) + (~known).sum() > MOST_PIECES:
                self.clear()
                known[:] = False
            self.learn(low, starts, ends, keys[~known], first[~known])
            at = np.searchsorted(self.keys, keys)
        piece = self.rank[at][back]
        lens = np.diff(self.starts)[piece]
        total = S.segments(lens)
        ids = self.ids[np.arange(total[-1]) + np.repeat(self.starts[piece] - total[:-1], lens)]
        return ids, total, starts

    def learn(self, low, starts, ends, keys, first) -> None:
        data = low.tobytes()
        text = b" ".join(data[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)).decode()
        ids = np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
        stop = np.flatnonzero(self.ends[ids]) + 1
        if len(stop) != len(keys):
            raise AssertionError("a piece doesn't end with an end-of-word token")
        n = len(self.starts) - 1
        keys, rank = np.concatenate([self.keys, keys]), np.concatenate([self.rank, np.arange(n, n + len(keys))])
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank = keys[order], rank[order]
        self.starts = np.concatenate([self.starts, stop + len(self.ids)])
        self.ids = np.concatenate([self.ids, ids])


_made: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each file and Python worker."""
    if path not in _made:
        _made[path] = Encoder(path)
        S.give_back()  # the file's text and what was parsed from it
    return _made[path]


def vocabulary(name: str) -> str:
    """Path of an installed public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)
