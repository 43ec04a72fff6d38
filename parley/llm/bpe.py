"""Byte-level BPE: piece splitting, cached encoding, and token counts at every prefix by dynamic programming.

Only vocabularies of the byte-level kind (a tokenizers .json file whose pre-tokenizer is ByteLevel with its
usual pattern) are read here.
"""

from __future__ import annotations

import functools
import json
import os
import re
from array import array

#: Letters and digits are separated in a second step, for a piece that mixes them.
#: \s is the Unicode White_Space property here, without the separators U+001C to U+001F.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
PIECES = re.compile(rf"'(?:[stmd]|re|ve|ll)| ?[^\W_]+| ?(?:[^\w{SPACE}]|_)+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
#: The pieces again, as tiktoken takes them.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Two white-space characters before another character: the last one belongs to the next piece.
BLANK = re.compile(rf"[{SPACE}]+")
RUNS = re.compile(rf"[{SPACE}]{{2,}}(?=[^{SPACE}])")
ENTRIES = 300_000


def _numeric_runs(piece: str) -> list[str]:
    """Split a piece of letters and digits where a letter meets a number (general categories L and N)."""
    lead, body = (" ", piece[1:]) if piece.startswith(" ") else ("", piece)
    out, kind = [], None
    for ch in body:
        number = not ch.isalpha()
        if number == kind:
            out[-1] += ch
        else:
            out.append(ch)
            kind = number
    out[0] = lead + out[0]
    return out


def split_pieces(text: str) -> list[str]:
    """The pieces that are merged independently of one another; joined, they are the text."""
    out = []
    for piece in PIECES.findall(text):
        if piece.isalpha() or not piece.lstrip(" ").isalnum():
            out.append(piece)
        else:
            out.extend(_numeric_runs(piece))
    return out


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use: printable Latin-1 for itself, others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Vocabulary:
    """Tokens as bytes, merge ranks, and strings that are whole tokens wherever they stand."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        if (spec.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or spec["model"]["type"] != "BPE":
            raise ValueError(f"not a byte-level BPE vocabulary: {path}")
        alphabet = _byte_alphabet()
        names = {x["content"] for x in spec["added_tokens"]}
        raw = lambda s: bytes(alphabet[c] for c in s)
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.ids = {raw(k): v for k, v in spec["model"]["vocab"].items() if k not in names}
        self.token = {v: k for k, v in self.ids.items()}
        self.longest = max(map(len, self.ids))
        self.ranks, self.parts = {}, {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            left, right = map(raw, merge.split(" ") if isinstance(merge, str) else merge)
            made = self.ids[left + right]
            self.ranks[self.ids[left], self.ids[right]] = (rank, made)
            self.parts.setdefault(made, (self.ids[left], self.ids[right], rank))

    def merge(self, piece: bytes) -> list[int]:
        """Merge by rank, the leftmost first among equals."""
        ids = [self.ids[piece[i : i + 1]] for i in range(len(piece))]
        while len(ids) > 1:
            best = min((self.ranks.get(p, (1 << 60, 0)) for p in zip(ids, ids[1:])), default=None)
            if best[0] == 1 << 60:
                break
            out, i = [], 0
            while i < len(ids):
                if i + 1 < len(ids) and self.ranks.get((ids[i], ids[i + 1])) == best:
                    out.append(best[1])
                    i += 2
                else:
                    out.append(ids[i])
                    i += 1
            ids = out
        return ids


def splitter(special: dict[str, int]) -> re.Pattern:
    """Splits a text into ordinary parts and, between them, the special strings; of two at one place the longer."""
    names = sorted(special, key=len, reverse=True)
    return re.compile("(" + "|".join(map(re.escape, names)) + ")" if names else "((?!))")


class Bounded(dict):
    """A dict that fills itself; of more than ENTRIES entries it keeps those used since the last turnover."""

    def __init__(self, make):
        super().__init__()
        self.make, self.old = make, {}

    def turn(self) -> None:
        if len(self) >= ENTRIES:
            self.old = dict(self)
            self.clear()

    def __missing__(self, key):
        self.turn()
        value = self.old.pop(key, None)
        value = self[key] = self.make(key) if value is None else value
        return value


class PrefixCounter:
    """Token counts at every prefix of a text.

    For a piece, a table over its byte positions holds the last token of each prefix's encoding: a prefix ends
    in token t exactly if t ends there and the pair (last token of the prefix before t, t) encodes to itself.
    One token per position meets that, so count[i] = count[i - len(t)] + 1. The counts are kept as differences
    from one code point to the next, a signed byte each; sums of them answer any prefix.
    """

    def __init__(self, path: str):
        self.vocabulary = Vocabulary(path)
        self.agrees = Bounded(self._agrees)
        self.spines = functools.lru_cache(maxsize=None)(self._spines)
        self.counted = Bounded(self._counted)
        self.special = splitter(self.vocabulary.special)

    def _spines(self, token: int, side: int) -> list[tuple[int, int]]:
        """The parts of a token that at some time reach its left (0) or right (1) edge, and the rank that ends each."""
        out, ends = [], 1 << 60
        while True:
            out.append((token, ends))
            made = self.vocabulary.parts.get(token)
            if made is None:
                return out
            ends, token = made[2], made[side]

    def _agrees(self, pair: int) -> bool:
        """Whether two neighbouring tokens stay as they are: no merge across their border comes in time.

        A part at the left token's right edge and a part at the right token's left edge merge if the rank of
        that pair is reached while both stand. Of equal ranks the leftmost pair is merged first.
        """
        ranks = self.vocabulary.ranks
        right = self.spines(pair & 0xFFFFFF, 0)
        for x, x_ends in self.spines(pair >> 24, 1):
            for y, y_ends in right:
                made = ranks.get((x, y))
                if made is not None and made[0] < x_ends and made[0] <= y_ends:
                    return False
        return True

    def table(self, piece: bytes) -> list[int]:
        """count[i] for i from 0 to len(piece)."""
        known, longest, agrees = self.vocabulary.ids.get, self.vocabulary.longest, self.agrees
        count, last, begin = [0], [-1], 0
        for i in range(1, len(piece) + 1):
            token = known(piece[:i]) if i <= longest else None
            if token is not None:
                last.append(token)
                count.append(1)
                begin = 0
                continue
            # Only one place fits, so the likely ones are tried first: the last token goes on, or a new one begins.
            token = known(piece[begin:i]) if begin else None
            if token is None or not agrees[last[begin] << 24 | token]:
                begin = i - 1
                token = known(piece[begin:i])
                if not agrees[last[begin] << 24 | token]:
                    for begin in range(max(1, i - longest), i - 1):
                        token = known(piece[begin:i])
                        if token is not None and agrees[last[begin] << 24 | token]:
                            break
            last.append(token)
            count.append(count[begin] + 1)
        return count

    def _counted(self, piece: str) -> bytes:
        """Differences for a piece as PIECES finds it, one for each code point."""
        body = piece[1:] if piece[0] == " " else piece
        if not body.isalpha() and body.isalnum():
            parts = _numeric_runs(piece)
            if len(parts) > 1:
                return b"".join(map(self._counted, parts))
        raw = piece.encode()
        count = self.table(raw)
        if piece in ("'re", "'ve", "'ll"):  # with one letter less these are two pieces
            return bytes((1, 1, (count[-1] - 2) & 255))
        if len(raw) == len(piece):
            return bytes([b - a & 255 for a, b in zip(count, count[1:])])
        out, at, before = bytearray(), 0, 0
        for ch in piece:
            at += len(ch.encode())
            out.append(count[at] - before & 255)
            before = count[at]
        return bytes(out)

    def _ordinary(self, text: str) -> bytes:
        if not RUNS.search(text):
            return b"".join(map(self.counted.__getitem__, PIECES.findall(text)))
        pieces = PIECES.findall(text)
        out = bytearray(b"".join(map(self.counted.__getitem__, pieces)))
        at = 0
        for piece, after in zip(pieces, pieces[1:]):
            at += len(piece)
            if BLANK.fullmatch(piece) and BLANK.match(after):
                # The prefix that ends after the run's last space has the whole run as one piece.
                run = self.counted[piece + after[0]]
                more = _signed(run[len(piece)]) - _signed(out[at])
                out[at] = (out[at] + more) & 255
                if at + 1 < len(out):
                    out[at + 1] = (out[at + 1] - more) & 255
        return bytes(out)

    def differences(self, text: str) -> bytes:
        """A signed byte for each code point: how many tokens more that prefix has than the one before."""
        parts, out = self.special.split(text), []
        for plain, name in zip(parts[::2], parts[1::2]):
            # Until its last character a special string is ordinary text.
            head = self._ordinary(plain + name[:-1])
            out.append(head + bytes([total(self._ordinary(plain)) + 1 - total(head) & 255]))
        return b"".join([*out, self._ordinary(parts[-1])])


def _signed(x: int) -> int:
    return x - 256 if x > 127 else x


def total(differences: bytes) -> int:
    """The token count of the whole text."""
    return sum(memoryview(differences).cast("b"))


#: Texts on which the two libraries have to agree before the faster one is used.
PROBES = [
    "it's we'll THEY'RE", "a  b   c\t\n\r\n d ", "x1y22 3.14 ½²", "é ß 漢字 😀 e\u0301", "__a_b--c...", "\x1c\u00a0 \u3000x\x85y", "<|end",
    "Ünïcode ǅ ª İ", " \n\n\n  x", "\U0001d7d8\U00010a60 ꙮ",
]


class Encoder:
    """Ids of whole texts, as the tokenizers library gives them for this file.

    The same vocabulary, read from the same file, runs in tiktoken, which merges in the order of the ids and is
    faster; it is used if that is the file's order of merges and both agree on PROBES, for texts without very long
    pieces (tiktoken merges those in quadratic time). Others go to tokenizers, piece by piece; special strings are
    taken out before.
    """

    LONG = 500

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs as many workers as there are cores
        import tiktoken
        from tokenizers import Tokenizer

        vocabulary = Vocabulary(path)
        self.tokenizer = Tokenizer.from_file(path)
        self.special = vocabulary.special
        self.split = splitter(self.special).split
        self.packed = Bounded(self._packed)
        self.fast = None
        if all(rank + 256 == made for rank, made in vocabulary.ranks.values()):
            fast = tiktoken.Encoding("fast", pat_str=PATTERN, mergeable_ranks=vocabulary.ids, special_tokens={})
            if all(fast.encode_ordinary(x) == self.tokenizer.encode(x, add_special_tokens=False).ids for x in PROBES):
                self.fast = fast

    def _packed(self, piece: str) -> bytes:
        return array("I", self.tokenizer.encode(piece, add_special_tokens=False).ids).tobytes()

    def _plain(self, text: str) -> bytes:
        if self.fast is not None and max(map(len, text.split(" "))) <= self.LONG and " " * self.LONG not in text:
            return self.fast.encode_to_numpy(text).tobytes()
        return b"".join(map(self.packed.__getitem__, PIECES.findall(text)))

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        parts = self.split(text)
        if len(parts) == 1:
            return self._plain(text)
        out = [array("I", [self.special[x]]).tobytes() if i % 2 else self._plain(x) for i, x in enumerate(parts)]
        return b"".join(out)


@functools.lru_cache(maxsize=2)
def prefix_counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)
