"""Token ids by the public tokenizers library, with a memo of text pieces between which its ids can't depend on each other."""

from __future__ import annotations

import functools
import string
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

#: Signs that end a word and never start a contraction.
SIGNS = ".,;:!?&$%#*|()"
#: What isn't a Latin letter that normalisation leaves a single letter; U+0130 is none, as its lower case has a mark.
NOT_LATIN = r"[^\x00-\x{12F}\x{131}-\x{24F}]"
#: Code points below are never joined by normalisation, so that a word of such letters is normalised and spelt letter by letter.
LATIN = 0x250
#: Longer units leave the memo after their batch, as it is bounded by their number.
LONG = 64


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """ids of whole texts as little-endian unsigned 32-bit integers.

    kind "word": the vocabulary drops white space, so pieces are cut at ASCII white space. kind "byte": white space belongs to the next word,
    so pieces are cut before a space that a letter, digit or ASCII sign follows. The library encodes each distinct piece once; a word of
    Latin letters goes straight to its model, in the letters that its normaliser and pre-tokenizer make of each. The memo has two
    generations of bounded size, and lives as long as the worker. The library's defaults hold: the literal of a special token in a text is
    that token, wherever it stands; texts with such a literal go to the library whole.
    """

    def __init__(self, path: str, kind: str, most: int = 300_000):
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.kind, self.most, self.young, self.old = kind, most, {}, {}
        self.spelling: dict[int, str] = {}
        for c in filter(str.isalpha, map(chr, range(LATIN))):
            spelt = self._spelt(c)
            if len(spelt) == 1:  # else normalised it isn't a single letter
                self.spelling[ord(c)] = spelt[0]
        space, all_ = " " if kind == "byte" else "", "".join(map(chr, self.spelling))
        if space:
            self.spelling[ord(space)] = self._spelt(" a")[0].removesuffix(self.spelling[ord("a")])
        plain = self._spelt(space + all_) == [(space + all_).translate(self.spelling)]
        self.letters = frozenset(all_ if plain else "")
        #: Whether capitals are read as small letters.
        self.small = plain and all(self.spelling[ord(c)] == self.spelling[ord(c.lower())] for c in string.ascii_uppercase)

    def _spelt(self, text: str) -> list[str]:
        """What the model gets of a text."""
        return [s for s, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(self.normalised(text))]

    def normalised(self, text: str) -> str:
        return text if self.tokenizer.normalizer is None else self.tokenizer.normalizer.normalize_str(text)

    @staticmethod
    def _bytes(text: str) -> list:
        parts = text.split(" ")
        if all(p and (p[0].isalnum() or "!" <= p[0] <= "~") for p in parts[1:]):
            return [parts[0], *[" " + p for p in parts[1:]]] if parts[0] else [" " + p for p in parts[1:]]
        out = [parts[0]]
        for p in parts[1:]:
            if p and (p[0].isalnum() or "!" <= p[0] <= "~"):
                out.append(" " + p)
            else:
                out[-1] += " " + p
        return [p for p in out if p]

    def _learn(self, new: list[str], chunk: int = 8_000) -> None:
        letters, spelling, tokenize, byte = self.letters, self.spelling, self.tokenizer.model.tokenize, self.kind == "byte"
        for at in range(0, len(new), chunk):
            words, rest, ids, ends = [], [], [], []
            for p in new[at : at + chunk]:
                word = p[1:] if byte and p[:1] == " " else p
                if word and letters.issuperset(word):
                    words.append(p)
                    ids += [t.id for t in tokenize(p.translate(spelling))]
                    ends.append(4 * len(ids))
                else:
                    rest.append(p)
            self._remember(words, ids, ends)
            if rest:
                e = self.tokenizer.encode(rest, is_pretokenized=True, add_special_tokens=False)
                w = np.array(e.word_ids, dtype=np.int64)
                self._remember(rest, e.ids, (4 * np.searchsorted(w, np.arange(len(rest)), side="right")).tolist())

    def _remember(self, units: list[str], ids: list[int], ends: list[int]) -> None:
        raw = np.array(ids, dtype="<u4").tobytes()
        for p, s, t in zip(units, [0, *ends], ends, strict=False):
            self.young[p] = raw[s:t]

    def _ids(self, units: list[str]) -> list[bytes]:
        """The ids of distinct units, by the memo."""
        if len(self.young) > self.most:
            self.old, self.young = self.young, {}
        young, old, new = self.young, self.old, []
        for p in units:
            if p not in young:
                if p in old:
                    young[p] = old[p]
                else:
                    new.append(p)
        self._learn(new)
        held = list(map(young.__getitem__, units))
        for p in new:
            if len(p) > LONG:
                del young[p]
        return held

    def _pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces, one after the other, and their bounds. A piece is cut into units where its ids can't depend on both
        sides: at line ends between signs, and before closing signs of a word. A line has three slots: its line end, its word, its signs."""
        whole = pa.array(pieces, pa.string())
        if self.kind == "byte":
            split = pc.split_pattern(whole, "\n")
            offsets, lines = split.offsets.to_numpy().astype(np.int64), split.flatten()
        else:
            offsets, lines = np.arange(len(whole) + 1), whole
        owner, first = np.repeat(np.arange(len(whole)), np.diff(offsets)), np.zeros(len(lines), dtype=bool)
        first[offsets[:-1]] = True
        several = np.flatnonzero((np.diff(offsets) > 1)[owner])
        ok = [bool(x) and not x[-1].isspace() and (f or x[0].isalnum()) for x, f in zip(_strings(lines.take(pa.array(several))), first[several].tolist(), strict=True)]
        uncut = np.zeros(len(whole), dtype=bool)
        uncut[owner[several[~np.array(ok, dtype=bool)]]] = True
        uncut = uncut[owner]
        stems = pc.utf8_rtrim(lines, characters=SIGNS)
        alpha, odd = pc.utf8_is_alpha(pc.utf8_ltrim(stems, characters=" ")), pc.match_substring_regex(stems, NOT_LATIN)
        cut = pc.and_(alpha, pc.not_equal(pc.binary_length(stems), pc.binary_length(lines)))
        cut = cut.to_numpy(zero_copy_only=False) & ~uncut
        for k in np.flatnonzero(cut & odd.to_numpy(zero_copy_only=False)).tolist():
            # normalised, a letter may end in a mark, which would join the signs
            cut[k] = self.normalised(stems[k].as_py().lstrip(" ")).isalpha()
        at = np.flatnonzero(cut)
        tails = [x[n:] for x, n in zip(_strings(lines.take(pa.array(at))), pc.utf8_length(stems.take(pa.array(at))).to_numpy().tolist(), strict=True)]
        body = pc.if_else(pa.array(cut), stems, lines)
        if self.small:
            body = pc.if_else(pc.and_not(alpha, odd), pc.ascii_lower(body), body)
        if uncut.any():
            body = pc.if_else(pa.array(uncut), pc.if_else(pa.array(first), whole.take(pa.array(owner)), ""), body)
        coded = body.dictionary_encode()
        units = _strings(coded.dictionary)
        number = {u: len(units) + k for k, u in enumerate(dict.fromkeys(["", "\n", *tails]))}
        slots = np.full((len(lines), 3), number[""], dtype=np.int64)
        slots[~first & ~uncut, 0] = number["\n"]
        slots[:, 1] = coded.indices.to_numpy()
        slots[at, 2] = [number[t] for t in tails]
        held = self._ids([*units, *number])
        size = np.fromiter(map(len, held), dtype=np.int64, count=len(held)) // 4
        flat, bounds = _gather(np.frombuffer(b"".join(held), "<u4"), np.r_[0, np.cumsum(size)], slots.ravel())
        return flat, bounds[3 * offsets]

    def encode(self, texts: pa.Array | Iterable[str | None]) -> list[bytes]:
        """The ids of each text. Arrow splits the texts and finds the distinct pieces of the whole batch; only those come to Python."""
        texts = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(list(texts), pa.string()), "")
        if not len(texts):
            return []
        special = functools.reduce(pc.or_, [pc.match_substring(texts, t) for t in self.special])
        if pc.any(special).as_py():
            out = self.encode(pc.if_else(special, "", texts))
            for k in np.flatnonzero(special.to_numpy(zero_copy_only=False)).tolist():
                out[k] = np.array(self.tokenizer.encode(texts[k].as_py(), add_special_tokens=False).ids, dtype="<u4").tobytes()
            return out
        parts = pc.split_pattern(texts, " ") if self.kind == "byte" else pc.ascii_split_whitespace(texts)
        ends = parts.offsets.to_numpy().astype(np.int64) - parts.offsets[0].as_py()
        coded = parts.flatten().dictionary_encode()
        pieces, codes, slow = _strings(coded.dictionary), coded.indices.to_numpy().astype(np.int64), []
        del parts, coded
        if self.kind == "byte":
            good = np.array([bool(p) and (p[0].isalnum() or "!" <= p[0] <= "~") for p in pieces], dtype=bool)
            bad = ~good[codes]
            bad[ends[:-1]] = False  # the first part of a text has no space before it, and may be anything
            slow = np.flatnonzero(np.add.reduceat(bad, ends[:-1], dtype=np.int64)).tolist()
            heads, head = np.unique(codes[ends[:-1]], return_inverse=True)
            spaced = [" " + p for p, g in zip(pieces, good.tolist(), strict=True) if g]
            codes = np.maximum(np.cumsum(good) - 1, 0)[codes]
            codes[ends[:-1]] = len(spaced) + head
            pieces = spaced + [pieces[k] for k in heads.tolist()]
        cut = [self._bytes(texts[k].as_py()) for k in slow]
        number = {p: len(pieces) + k for k, p in enumerate(dict.fromkeys(p for ps in cut for p in ps))}
        flat, bounds = self._pieces(pieces + list(number))
        ids, until = _gather(flat, bounds, codes)
        raw, until = memoryview(ids.view(np.uint8)), (4 * until[ends]).tolist()
        out = [bytes(raw[s:e]) for s, e in zip(until, until[1:], strict=False)]
        for k, ps in zip(slow, cut, strict=True):
            out[k] = _gather(flat, bounds, np.array([number[p] for p in ps], dtype=np.int64))[0].tobytes()
        return out


def _strings(column: pa.Array) -> list[str]:
    """As to_pylist, without a scalar object for each row."""
    return column.to_numpy(zero_copy_only=False).tolist()


def _gather(flat: np.ndarray, bounds: np.ndarray, codes: np.ndarray, step: int = 1 << 15) -> tuple[np.ndarray, np.ndarray]:
    """The runs of flat that codes name, one after the other, and their bounds; run k is flat[bounds[k] : bounds[k + 1]]. Positions, which
    take several times the room of ids, are made for ``step`` runs at a time."""
    until = np.zeros(len(codes) + 1, dtype=np.int64)
    np.cumsum((bounds[1:] - bounds[:-1])[codes], out=until[1:])
    out = np.empty(int(until[-1]), dtype=flat.dtype)
    for k in range(0, len(codes), step):
        part, u = codes[k : k + step], until[k : k + step + 1]
        at = np.arange(u[0], u[-1])
        at += np.repeat(bounds[part] - u[:-1], np.diff(u))
        out[u[0] : u[-1]] = flat[at]
    return out, until


@functools.cache
def encoder(path: str, kind: str, most: int = 300_000) -> Encoder:
    return Encoder(path, kind, most)
