"""The spoken words of a subtitle file, and forms of a word that damage to its characters doesn't change.

A file is a list of cues in either of the two common styles. Cue numbers, times, headers and markup are no speech, nor
are sound descriptions (in brackets or notes over all lines of a cue, or a line or word between asterisks) and the names
of speakers. An advert is a whole cue that holds an address, a credit a short one that begins with one of the known phrases. What is left is one sequence of words over all lines and cues. A word that a hyphen splits at a line's end is
put together, and a sentence that begins right behind a full stop is a new word.

Some of this can't be told from speech for certain: what reads like an advert, a name that isn't in capitals or stands
in a line of capitals, a line between marks that may be damaged notes. Such parts are doubtful. ``read`` gives them with
their number, ``tokens`` leaves them out, and ``stretches`` gives the text around each of them as it reads if it is spoken.

Wrongly decoded text is decoded back where that is possible. Two forms of a word serve comparison:

* ``fine``: lower case, no accents, no punctuation, and letters that are misread for one another spelled alike, by
  spelling out each pair as its narrower parts (m as rn, d as cl, w as vv, u as ii, h as li) before merging single
  letters. ``*`` stands for up to two letters that the damage has hidden.
* ``skeleton``: the letters of ``fine`` that neither misreading nor lost accents can touch.

Everything here is plain Python on one text, for use inside Arrow batches.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator

# How the credits of subtitle files begin; dots stand for accented letters. Adverts are told by their address.
CREDITS = (
    r"subtitles? by\b", r"sync(?:ed|hronized)? (?:and|&) corrected by\b", r"support us and become\b", r"untertitel von\b", r".{1,3}berarbeitet von\b",
    r"sous-titres? ?:", r"relecture et synchro", r"correcci.{0,3}n y sincron.{0,3}a", r"subt.{0,3}tulos por\b",
)
# Letters that scanning takes for one another. Wide ones are spelled as their parts, then narrow ones merged.
WIDE = {"m": "rn", "d": "cl", "w": "vv", "u": "ii", "h": "li"}
NARROW = {"c": "e", "l": "i", "1": "i", "|": "i", "0": "o", "a": "o", "t": "f", "5": "s", "9": "g", "8": "b"}
HIDDEN_BY_ACCENTS = "eion"

_CREDIT = re.compile(r"(?:" + "|".join(CREDITS) + r")", re.IGNORECASE)
# every part has a bound, so that an endless word costs no more than its length
_ADDRESS = re.compile(
    r"[^\s@]{1,64}@[^\s@.]{1,64}\.[^\s@]{2,64}|\b[A-Za-z]{2,9}://\S*|\bwww\.\S+|\b[a-z0-9-]{1,63}(?:\.[a-z0-9-]{1,63}){0,6}\.[a-z][a-z0-9]{1,23}(?:/\S*|(?=[ \t]{0,9}$))",
    re.MULTILINE,
)
_MARKUP = re.compile(r"<[^<>\n]*>|\{[^{}\n]*\}")
_DOT = re.compile(r"[A-Za-z0-9-]\.[a-z]")
_BRACKETS = re.compile(r"\([^()]*\)|\[[^\[\]]*\]")
_NOTES = re.compile(r"♪[^♪]*♪")
_STARS = re.compile(r"\*(?=\S)[^*\n]*(?<=\S)\*|^\*[^*\n]*\*$", re.MULTILINE)
_MARKED = re.compile(r"([?�♪#]) .* \1")
_SPEAKER = re.compile(r"(?:[-–—]\s*)?([^\s:]{2,40}|[^a-z:]{2,40}) ?:\s+")
_STUCK = re.compile(r"(?<=[a-zß-öø-ÿ][.!])(?=[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ])")
#: Longer cues that begin like a credit are speech.
CREDIT_WORDS = 12
_FOREIGN = re.compile(r"[^\x00-\x7f]+")
_SUSPECT = re.compile(r"[^\x00-\x7fàáâäçèéêëìíîïñòóôöùúûüßœÀÁÄÇÈÉÊËÌÍÎÏÑÒÓÔÖÙÚÛÜŒ¿¡♪�]|[ÃÂ]")
_WIDE_TABLE = str.maketrans(WIDE)
_NARROW_TABLE = str.maketrans(NARROW)
_KEEP = re.compile(r"[^a-z0-9|*]+")
_DROP = re.compile(r"ss|[" + HIDDEN_BY_ACCENTS + r"*]")
_MEMO_LIMIT = 200_000
_SLOPPY = {c: b for b in range(256) for c in [bytes([b]).decode("cp1252", "replace")] if c != "�"} | {chr(b): b for b in (0x81, 0x8D, 0x8F, 0x90, 0x9D)}


class Memo(dict):
    """Results of a function of one word, forgotten all at once when there are too many."""

    def __init__(self, made):
        self.made = made

    def __missing__(self, key):
        if len(self) >= _MEMO_LIMIT:
            self.clear()
        value = self[key] = self.made(key)
        return value


def _decode_again(run: str) -> str:
    """A run of characters beyond ASCII, decoded as UTF-8 if it was read as a Western code page, once or twice over."""
    for _ in range(3):
        try:
            better = bytes(_SLOPPY[c] for c in run).decode("utf-8")
        except (KeyError, UnicodeDecodeError):
            break
        run = better
    out = []
    for c in run:
        if c not in "♪�" and not unicodedata.name(c, "").startswith("LATIN"):  # a letter of the DOS code page in a Western letter's place
            try:
                letter = c.encode("cp437").decode("latin-1")
                c = letter if letter.isalpha() else c
            except UnicodeEncodeError:
                pass
        out.append(c)
    return "".join(out)


_decoded = Memo(_decode_again)


def words_of(line: str) -> list[str]:
    """The words of a line, also where no blank follows a full stop."""
    return (_STUCK.sub(" ", line) if ("." in line or "!" in line) and _STUCK.search(line) else line).split()


class _Reader:
    """The words of one text so far, with the number of the doubtful part that each belongs to, 0 if to none."""

    def __init__(self) -> None:
        self.words: list[str] = []
        self.parts: list[int] = []
        self.last, self.carried = 0, ""

    def doubtful(self, words: list[str]) -> None:
        if words:
            self.last += 1
            self.words += words
            self.parts += [self.last] * len(words)

    def certain(self, words: list[str]) -> None:
        if self.carried:
            words[0] = self.carried + words[0]
            self.carried = ""
        end = words[-1]
        if end[-1] == "-" and len(end) > 1 and end[-2] != "-":
            self.carried = words.pop()[:-1]
        self.words += words
        self.parts += [0] * len(words)

    def cue(self, lines: list[str]) -> None:
        text = "\n".join(lines) if len(lines) > 1 else lines[0]
        changed = False
        if "<" in text or "{" in text:
            text, changed = _MARKUP.sub("", text), True
        if "(" in text or "[" in text:
            text, changed = _BRACKETS.sub(" ", text), True
        if "♪" in text:
            text, changed = _NOTES.sub(" ", text), True
        if changed:
            text = "\n".join(line.strip() for line in text.split("\n"))
        if "*" in text:
            text, changed = _STARS.sub(" ", text), True
        if ("@" in text or "://" in text or ("." in text and _DOT.search(text))) and _ADDRESS.search(text):
            self.doubtful(words_of(_ADDRESS.sub(" ", text)))
            return
        if _CREDIT.match(text) and len(words := words_of(text)) <= CREDIT_WORDS:
            self.doubtful(words)
            return
        for line in text.split("\n") if changed else lines:
            line = line.strip()
            if not line:
                continue
            if line[0] in "?�#♪" and _MARKED.fullmatch(line):
                self.doubtful(words_of(line[1:-1]))
                continue
            if ":" in line and (name := _SPEAKER.match(line)):
                line = line[name.end() :]
                if name[1] != name[1].upper() or line == line.upper():
                    self.doubtful(words_of(name[1]))
            words = words_of(line)
            if words and words[0] in "-–—":
                del words[0]
            if words:
                self.certain(words)


def read(text: str | None) -> tuple[list[str], list[int]]:
    """The words as written, in order, over the whole text, doubtful parts by their numbers. Null and empty texts have none."""
    out = _Reader()
    if not text:
        return [], []
    if not text.isascii() and _SUSPECT.search(text):
        text = _FOREIGN.sub(lambda m: _decoded[m.group()], text)
    lines: list[str] = []
    for line in text.split("\n"):
        line = line.strip(" \t\r﻿")
        if not line or "-->" in line or line.isdigit() or line == "WEBVTT":
            if lines:
                out.cue(lines)
                lines = []
            continue
        lines.append(line)
    if lines:
        out.cue(lines)
    if out.carried:
        out.words.append(out.carried)
        out.parts.append(0)
    return out.words, out.parts


def tokens(text: str | None) -> list[str]:
    """The spoken words as written, in order, without what is doubtful."""
    words, parts = read(text)
    return [w for w, p in zip(words, parts) if not p] if any(parts) else words


def stretches(words: list[str], parts: list[int], reach: int) -> Iterator[list[str]]:
    """For each doubtful part, it and up to ``reach`` words on both sides, the other doubtful parts left out, then taken."""
    certain = [i for i, p in enumerate(parts) if not p]
    at, n = 0, len(words)
    while at < n:
        if not parts[at]:
            at += 1
            continue
        end = at + 1
        while end < n and parts[end] == parts[at]:
            end += 1
        k = bisect_left(certain, at)
        before, after = certain[max(0, k - reach) : k], certain[k : k + reach]
        yield [words[i] for i in (*before, *range(at, end), *after)]
        if any(parts[max(0, at - reach) : at]) or any(parts[end : end + reach]):
            yield words[max(0, at - reach) : end + reach]
        at = end


def _fine(word: str) -> str:
    if not word.isascii():
        out = []
        for c in word:
            if c < "\x80":
                out.append(c)
            elif c in "�ßẞ":
                out.append("*")
            elif c in "œŒæÆ":
                out.append("oe" if c in "œŒ" else "ae")
            else:
                base = unicodedata.normalize("NFD", c)[0]
                if base.isascii():
                    out.append(base)
                elif c.isalpha():
                    out.append("*")
        word = "".join(out)
    inner = word.lower().strip("\"'.,;:!-#&()[]_/ ­")
    inner = inner.replace("?", "*")
    inner = _KEEP.sub("", inner)
    if not any("a" <= c <= "z" for c in inner) and not (len(inner) < 3 and "|" in inner):
        return ""
    return inner.translate(_WIDE_TABLE).translate(_NARROW_TABLE)


fine = Memo(_fine)


def hides_a_word(word: str) -> bool:
    """Whether nothing is left of a word but one hidden letter, or its two bytes. It may as well be punctuation, so it has no ``fine`` form."""
    inner = word.strip("\"'.,;:!-#&()[]_/ ­")
    return 0 < len(inner) < 3 and not inner.strip("?�")


def may_be_hidden(word: str) -> bool:
    """Whether damage to its characters may hide all of a word: its only letter is beyond ASCII."""
    letters = [c for c in unicodedata.normalize("NFC", word) if c.isalnum()]
    return len(letters) == 1 and not letters[0].isascii() and fine[word] != ""


def skeleton(form: str) -> str:
    """The part of a ``fine`` form that damage leaves as it is."""
    return _DROP.sub("", form)


def forms(text: str | None) -> list[str]:
    """``fine`` forms of the spoken words, without words that have no letter."""
    return [f for f in map(fine.__getitem__, tokens(text)) if f]


_patterns = Memo(lambda form: re.compile(re.escape(form).replace(r"\*", ".{0,2}")))


def alike(a: str, b: str) -> bool:
    """Whether two ``fine`` forms may be the same word."""
    if a == b:
        return True
    if "*" in a:
        return _patterns[a].fullmatch(b) is not None or ("*" in b and a.replace("*", "") == b.replace("*", ""))
    return "*" in b and _patterns[b].fullmatch(a) is not None
