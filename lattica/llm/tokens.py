"""Exact tokenisation with the libraries' own results.

``PieceEncoder`` (sentencepiece BPE) and ``WordEncoder`` (tokenizers, BPE with word ends) remember what
the library gave for parts of a text that no merge can cross, and ask the library for each new part.

A position between characters ``a`` and ``b`` is *stable* when no piece of the vocabulary holds ``ab``:
no BPE merge can then join the two sides, so both sides are encoded alike in whatever text they stand.
"""

from __future__ import annotations

import functools
import json
import re
from array import array

import numpy as np
import pyarrow as pa

from lattica.llm.words import split_batch

_MEMO_LIMIT = 800_000
_WORD_LIMIT = 1_200_000


class PieceEncoder:
    """Tokens of a sentencepiece BPE model."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        m = self.model
        normal = [i for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i))]
        self.pairs = {p[i : i + 2] for p in map(m.id_to_piece, normal) for i in range(len(p) - 1)}
        # Splitting before spaces and around line ends needs three facts of this vocabulary; without them, or
        # with a normaliser that rewrites text, whole texts go to the library.
        probe = "a  b\tc ﬁ\n\nd "
        spaces = all(p[0] == "▁" or p[1] != "▁" for p in self.pairs)
        lines = not any("\n" in p for p in self.pairs)
        plain = "".join(m.decode(m.encode(probe))) == probe and len(m.encode("\nb")) - len(m.encode("b")) == 1 + (m.encode("b")[0] != m.encode("\nb")[-1])
        self.local = spaces and lines and plain and self._is_bpe(path)
        self.lead = m.encode("\n")
        self.counts: dict[str, int] = {}

    @staticmethod
    def _is_bpe(path: str) -> bool:
        from sentencepiece import sentencepiece_model_pb2 as pb

        spec = pb.ModelProto()
        with open(path, "rb") as f:
            spec.ParseFromString(f.read())
        n = spec.normalizer_spec
        user = any(p.type == pb.ModelProto.SentencePiece.USER_DEFINED for p in spec.pieces)
        return spec.trainer_spec.model_type == pb.TrainerSpec.BPE and not n.precompiled_charsmap and not n.remove_extra_whitespaces and n.add_dummy_prefix and n.escape_whitespaces and not user

    def stable(self, text: str, at: int) -> bool:
        """Whether no token can span position ``at`` of ``text``: proven from the vocabulary."""
        pair = text[at - 1 : at + 1].replace(" ", "▁")
        return pair not in self.pairs

    def boundaries(self, text: str, first: bool) -> list[int]:
        """Token begins, as offsets into ``text``; ``first``: it opens the document, which gets a dummy blank before it."""
        pieces = self.model.encode(text if first else "\n" + text, out_type=str)
        out, at, pending = [], 0, 0
        skip = 1 if first else len(self.lead)
        # the dummy blank (and the line end put before an inner chunk) stand at negative offsets
        at = -1 if first else -2
        for p in pieces:
            out.append(at)
            if len(p) == 6 and p.startswith("<0x"):
                byte = int(p[3:5], 16)
                if pending:
                    pending -= 1
                else:
                    pending = 3 if byte >= 0xF0 else 2 if byte >= 0xE0 else 1 if byte >= 0xC0 else 0
                at += not pending
            else:
                at += len(p)
        return out if first else out[skip:]

    _PART = re.compile(r"\n|[^\n ]+| +[^\n ]*")

    def count(self, text: str, first: bool = True) -> int:
        """Number of tokens; an inner chunk (not ``first``) gets no dummy blank."""
        if not text:
            return 0
        text = text.replace("▁", " ")  # the library writes blanks so
        if not self.local:
            return len(self.model.encode(text)) if first else len(self.model.encode("\n" + text)) - len(self.lead)
        return sum(self._counts_of(self._PART.findall(" " + text if first else text)))

    def _counts_of(self, parts: list[str]) -> list[int]:
        """Tokens of each part; parts may hold line ends, and blanks at their beginning."""
        counts = self.counts
        try:
            return list(map(counts.__getitem__, parts))
        except KeyError:
            new = {p for p in parts if p not in counts}
        if len(counts) + len(new) > _MEMO_LIMIT:
            counts.clear()
            new = set(parts)
        # A line end, and a full stop or comma at a part's end, are counted by themselves where that is proven right.
        split = {}
        for p in new:
            pieces = []
            for i, x in enumerate(p.split("\n")):
                if i:
                    pieces.append("\n")
                if len(x) > 1 and x[-1] in ".," and x[-2] != " " and x[-2:] not in self.pairs:
                    pieces += [x[:-1], x[-1]]
                elif x:
                    pieces.append(x)
            split[p] = pieces
        asked = [x for x in {x for y in split.values() for x in y} if x != "\n" and x not in counts]
        newline = self.lead[-1]
        for i in range(0, len(asked), 256):  # many parts in one call, a line end between them: no merge crosses one
            some = asked[i : i + 256]
            ids = np.array(self.model.encode("\n" + "\n".join(some)), np.int64)
            ends = np.append(np.flatnonzero(ids == newline), len(ids))
            counts.update(zip(some, (np.diff(ends) - 1).tolist(), strict=True))
        counts["\n"] = 1
        for p, pieces in split.items():
            counts[p] = sum(map(counts.__getitem__, pieces))
        return list(map(counts.__getitem__, parts))

    def count_many(self, texts: list[str]) -> list[int]:
        """``count`` of each text, for many texts at once."""
        out = [0] * len(texts)
        easy = []
        for i, t in enumerate(texts):
            if not self.local or "  " in t or "▁" in t or t[:1] == " ":
                out[i] = self.count(t)
            elif t:
                easy.append(i)
        if easy:
            offsets, index, distinct = split_batch(pa.array([texts[i] for i in easy], pa.large_string()), " ")
            n = np.array(self._counts_of([" " + w for w in distinct]), np.int64)
            sums = np.concatenate([[0], np.cumsum(n[index])])
            for i, x in zip(easy, (sums[offsets[1:]] - sums[offsets[:-1]]).tolist(), strict=True):
                out[i] = x
        return out


def count_whole(encoder, text: str, chunk: int, overlap: int) -> int:
    """Tokens of ``text``, encoding at most about ``chunk`` characters at once.

    Chunk k covers ``[k * chunk, (k + 1) * chunk + overlap)``.  Both neighbours encode the overlap with
    offsets; they are spliced at a token boundary that both have and that is proven stable.  Where the
    overlap has none, it is doubled and encoded again, up to the rest of the text.
    """
    if len(text) <= chunk + overlap:
        return encoder.count(text)
    total, begin, at = 0, 0, 0
    while True:
        end = at + chunk
        if len(text) <= end + overlap:
            return total + encoder.count(text[begin:], begin == 0)
        width = overlap
        while True:
            cut = _splice(encoder, text, end, min(width, len(text) - end))
            if cut is not None or end + width >= len(text):
                break
            width *= 2
        if cut is None:
            return total + encoder.count(text[begin:], begin == 0)
        total += encoder.count(text[begin:cut], begin == 0)
        begin, at = cut, end


def _splice(encoder, text: str, at: int, width: int) -> int | None:
    """A stable boundary in ``[at, at + width)`` on which the left and the right chunk agree, nearest to the middle."""
    back = max(0, at - width)
    left = {x + back for x in encoder.boundaries(text[back : at + width], back == 0)}
    right = {x + at for x in encoder.boundaries(text[at : at + width], False)}
    both = [x for x in left & right if at < x < at + width and encoder.stable(text, x)]
    return min(both, key=lambda x: (abs(x - at - width // 2), x)) if both else None


#: The characters that byte-level models use for the 256 bytes: printable ones for themselves, the rest from U+0100 on.
_SELF = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE = {b: chr(b) for b in _SELF} | {b: chr(256 + i) for i, b in enumerate(sorted({*range(256)} - {*_SELF}))}
_LATIN = bytes([9, 10, 13, *range(32, 127), *range(161, 256)])


class WordEncoder:
    """Ids of a ``tokenizers`` file; texts of plain Latin letters are put together from remembered words."""

    # NFC leaves these characters alone and each is lower-cased by itself, so ASCII white space separates texts
    # into parts that the library encodes independently. Any other text goes to the library whole.
    _PLAIN = re.compile(r"[\t\n\r\x20-\x7e¡-ɏ‐-―‘-•…]*")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kinds = [n.get("type") for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        self.local = kinds == ["NFC", "Replace", "Lowercase"] and spec["model"].get("end_of_word_suffix") == "</w>" and spec.get("post_processor") is None
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.tokenize = self.library.model.tokenize
        self.whole: dict[str, bytes] = {}

    def _plain(self, text: str) -> bool:
        try:
            return not text.encode("latin-1").translate(None, _LATIN)
        except UnicodeEncodeError:
            return bool(self._PLAIN.fullmatch(text))

    def _ask(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.library.encode_batch(texts, add_special_tokens=False)]

    def encode(self, text: str) -> bytes:
        """The ids as native unsigned 32-bit numbers."""
        if not text:
            return b""
        if not self.local or not self._plain(text) or any(s in text for s in self.special):
            return self._ask([text])[0]
        return b"".join(self._of(text.split()))

    def _of(self, parts: list[str]) -> list[bytes]:
        whole = self.whole
        found = list(map(whole.get, parts))
        new = [i for i, ids in enumerate(found) if ids is None]
        if new:
            if len(whole) > _WORD_LIMIT:
                whole.clear()
                new = range(len(parts))
            self._learn({parts[i] for i in new})
            for i in new:
                found[i] = whole[parts[i]]
        return found

    def encode_many(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        out = [np.zeros(0, np.uint32)] * len(texts)
        easy = []
        for i, t in enumerate(texts):
            if self.local and self._plain(t) and not any(s in t for s in self.special):
                easy.append(i)
            else:
                out[i] = np.frombuffer(self.encode(t), np.uint32)
        if easy:
            offsets, index, distinct = split_batch(pa.array([texts[i] for i in easy], pa.large_string()))
            known = self._of(distinct)
            n = np.fromiter(map(len, known), np.int64, len(known)) // 4
            first = np.concatenate([[0], np.cumsum(n)])[:-1]
            flat = np.frombuffer(b"".join(known), np.uint32)
            each = n[index]
            upto = np.concatenate([[0], np.cumsum(each)])
            ids = flat[np.repeat(first[index] - upto[:-1], each) + np.arange(upto[-1])]
            ends = upto[offsets]
            for i, a, b in zip(easy, ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                out[i] = ids[a:b]
        return out

    _RUN = re.compile(r"[a-z]+|[0-9]")

    def _word(self, w: str) -> bytes:
        """Ids of lower-case letters, which the library takes as one word, given to the model in its byte letters."""
        return array("I", [t.id for t in self.tokenize(w if w.isascii() else "".join(map(_BYTE.__getitem__, w.encode())))]).tobytes()

    def _learn(self, parts: set[str]) -> None:
        """Split off what stands before and after the letters, which the library splits off too, and learn each new word.

        The library also splits letters from digits, and each digit from the next.
        """
        whole, split, other = self.whole, {}, set()
        whole[""] = b""
        for p in parts:
            q = p.lower()
            if q.isalpha():
                ids = whole.get(q)
                if ids is None:
                    ids = whole[q] = self._word(q)
                whole[p] = ids
                continue
            core = q.strip(".,;:!?()\"")
            if not (core and core[0].isalnum() and core[-1].isalnum()):
                core = q
            if core not in whole:
                if core.isalpha():
                    whole[core] = self._word(core)
                elif core.isascii() and core.isalnum():
                    whole[core] = b"".join([whole[x] if x in whole else whole.setdefault(x, self._word(x)) for x in self._RUN.findall(core)])
                else:
                    other.add(core)
            if core != p:
                at = q.index(core)
                split[p] = x = (q[:at], core, q[at + len(core) :])
                other.update(y for y in (x[0], x[2]) if y not in whole)
        asked = list(other)
        for w, ids in zip(asked, self._ask(asked), strict=True):
            whole[w] = ids
        for p, x in split.items():
            whole[p] = whole[x[0]] + whole[x[1]] + whole[x[2]]


@functools.lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    """The encoder of this process: what it remembers serves all tasks that a Python worker runs."""
    return WordEncoder(path)
