"""The transducer behind ``lookalikes``: text by grapheme clusters into its one usual form.

One table is compiled from rules and checked: forms that hold everywhere (widths, presentation forms, accents,
spaces, unseen characters, hyphens), and forms that hold in words of one script (look-alike letters of Latin,
Greek and Cyrillic, Arabic letters in Persian). The transducer reads clusters once, longest match first, holds
a word back until it ends, and writes it in the forms of the script that the word shows.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from dataclasses import dataclass
from functools import cached_property, lru_cache

import regex

#: Letters that look like Latin ones, by script.
CYRILLIC = dict(zip("АВЕКМНОРСТУХЅІЈҮԌԚԜаеорсухѕіјһӏԁԛԝ", "ABEKMHOPCTYXSIJYGQWaeopcyxsijhldqw"))
GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονρυικαγχ", "ABEZHIKMNOPTYXovpuikayx"))
LATIN_FORMS = {"ɑ": "a", "ɡ": "g", "ᴏ": "o", "ⅼ": "l", "ⅰ": "i", "ꓑ": "P"}
#: Arabic letters that stand for Persian ones, and letters that only Arabic text has.
ARABIC = {"ك": "ک", "ي": "ی", "ى": "ی", "ھ": "ه", "ہ": "ه"}
ONLY_ARABIC = frozenset("ةإ")
#: Characters that show nothing, spaces that look like the plain one, hyphens that look like it.
UNSEEN = "­͏؜ᅟᅠ឴឵᠎​‎‏‪‫‬‭‮⁠⁡⁢⁣⁤⁦⁧⁨⁩﻿"
SPACES = "               　"
HYPHENS = "‐‑"
#: Clusters looked at after a joiner.
AHEAD = 32
JOINERS = "‌‍"


class Conflict(ValueError):
    """Two rules want different forms of the same cluster, or a form isn't final."""


def compile_table() -> dict[str, str]:
    """Clusters and their usual form, checked: one form each, and no form that another rule would change."""
    found: dict[str, str] = {}

    def add(source: str, target: str) -> None:
        if found.setdefault(source, target) != target:
            raise Conflict(f"{source!r}: {found[source]!r} or {target!r}")

    for c in map(chr, range(0x80, sys.maxunicode + 1)):
        kind = unicodedata.decomposition(c)
        if not kind or c in SPACES:
            continue
        if kind[0] != "<":
            whole = unicodedata.normalize("NFC", c)
            parts = unicodedata.normalize("NFD", c)
            if whole != c:
                add(c, whole)
            elif len(whole) == 1 and len(parts) > 1:
                add(parts, c)
                half = unicodedata.normalize("NFD", parts[0]) + parts[1:]
                if half != parts:
                    add(half, c)
        elif kind.startswith(("<wide>", "<narrow>", "<initial>", "<medial>", "<final>", "<isolated>")) or 0xFB00 <= ord(c) <= 0xFB06:
            plain = unicodedata.normalize("NFKC", c)
            if " " not in plain:
                add(c, "" if plain in UNSEEN else plain)
    for chars, target in ((UNSEEN, ""), (SPACES, " "), (HYPHENS, "-")):
        for c in chars:
            add(c, target)
    for source, target in found.items():
        if target in found or source != target and unicodedata.normalize("NFC", target) != target:
            raise Conflict(f"{source!r} becomes {target!r}, which isn't final")
    return found


LATIN, GREEK_WORD, CYRILLIC_WORD, PERSIAN = "latin", "greek", "cyrillic", "persian"


@dataclass(frozen=True)
class Table:
    """Forms that hold in any word, and those of a word's script besides."""

    everywhere: dict[str, str]
    within: dict[str, dict[str, str]]

    @cached_property
    def characters(self) -> dict[int, str]:
        """The forms of single characters."""
        return {ord(c): form for c, form in self.everywhere.items() if len(c) == 1}


def compile_contexts(everywhere: dict[str, str]) -> dict[str, dict[str, str]]:
    """Forms by script, checked against each other and against those that hold everywhere.

    Within a script a letter has one form, no form is changed again there, and none is one that holds everywhere.
    Back from Latin, the first of the letters that look alike in that script is the form.
    """

    def inverse(letters: dict[str, str], rare: str) -> dict[str, str]:
        back: dict[str, str] = {}
        for letter, latin in letters.items():
            if letter not in rare:
                back.setdefault(latin, letter)
        return back

    found = {LATIN: {}, GREEK_WORD: inverse(GREEK, ""), CYRILLIC_WORD: inverse(CYRILLIC, "ҮԌԚԜԁԛԝһӏ"), PERSIAN: dict(ARABIC)}
    for letters in (CYRILLIC, GREEK, LATIN_FORMS):
        for letter, latin in letters.items():
            if found[LATIN].setdefault(letter, latin) != latin:
                raise Conflict(f"{letter!r}: {found[LATIN][letter]!r} or {latin!r}")
    for script, forms in found.items():
        for source, target in forms.items():
            if target in forms:
                raise Conflict(f"{script}: {source!r} becomes {target!r}, which isn't final")
            if everywhere.get(source, source) != source or everywhere.get(target, target) != target:
                raise Conflict(f"{script}: {source!r} or {target!r} has another form everywhere")
    return found


@lru_cache(maxsize=1)
def _table() -> Table:
    everywhere = compile_table()
    return Table(everywhere, compile_contexts(everywhere))


#: Extended grapheme clusters: Hangul syllables, Indic conjuncts and emoji sequences are one each. Without any of the
#: characters that make longer ones, each character is its own cluster.
_CLUSTER = regex.compile(r"\X")
_LONGER = regex.compile(r"[\p{Grapheme_Extend}\p{M}\p{Prepended_Concatenation_Mark}\p{Regional_Indicator}\u0e33\u0eb3\u1100-\u11ff\ua960-\ua97f\ud7b0-\ud7ff\u200d\r]")
_LATIN = re.compile(r"[A-Za-zÀ-ÖØ-öø-ɏ]")
_WIDE_LATIN = re.compile(r"[A-Za-zÀ-ÖØ-öø-ɏＡ-Ｚａ-ｚﬀ-ﬆ]")
_ARABIC_LETTER = re.compile(r"[ؠ-يٮ-ۓۺ-ۿً-ٟ]")
_ALPHABETS = ((GREEK_WORD, re.compile(r"[Ͱ-Ͽ]")), (CYRILLIC_WORD, re.compile(r"[Ѐ-ԯ]")))
_JOINED = re.compile(r"[\u200c\u200d]+")
#: Where a text was cut short: a mark for what is left out, or its end. A joiner before it was that of a whole word.
_CUT = re.compile(r"\s*(?:\.{3}|…|\[(?:more|…)\]|$)")
#: What makes a word's script or a joiner matter.
_TELLING = re.compile("[" + re.escape("".join({*LATIN_FORMS, *ARABIC})) + "\u0370-\u03ff\u0400-\u052f" + "\u200c\u200d\ufb50-\ufeff]")
_PRESENTED = frozenset(c for c in map(chr, range(0xFB50, 0xFF00)) if set(unicodedata.normalize("NFKC", c)) & ONLY_ARABIC)


@dataclass(frozen=True)
class Surroundings:
    """What a whole text shows: Latin letters, letters that only Arabic has, alphabets with letters of their own."""

    latin: bool
    arabic: bool
    own: frozenset[str]

    @classmethod
    def of(cls, text: str, lookalikes: dict[str, str]) -> Surroundings:
        letters = set(text)
        own = frozenset(name for name, letter in _ALPHABETS if any(c not in lookalikes and letter.match(c) for c in letters))
        return cls(bool(_WIDE_LATIN.search(text)), not letters.isdisjoint(ONLY_ARABIC | _PRESENTED), own)


def _script(word: list[str], around: Surroundings, lookalikes: dict[str, str], table: Table) -> str | None:
    """The script whose forms a word is written in; None if it stays as it is."""
    letters = [c for cluster in word for c in cluster]
    latin = sum(1 for c in letters if _LATIN.match(c))
    alike = [c for c in letters if c in lookalikes]
    own = {name: n for name, letter in _ALPHABETS if (n := sum(1 for c in letters if c not in lookalikes and letter.match(c)))}
    if alike and not own:
        # A letter by itself is taken for Latin only where the text has no other trace of its alphabet.
        foreign = {name for name, letter in _ALPHABETS if any(letter.match(c) for c in alike)}
        alone = len(letters) == 1 and not foreign.isdisjoint(around.own)
        return LATIN if latin or around.latin and not alone else None
    if latin and len(own) == 1:
        ((name, n),) = own.items()
        fits = all(c in table.within[name] for c in letters if _LATIN.match(c))
        return name if n >= latin and fits else None
    return PERSIAN if not around.arabic and any(c in ARABIC for c in letters) else None


def _joiner(run: str, before: str, after: str) -> str:
    """What stays of a run of joiners: the non-joiner inside Persian words, cut ones too, and the joiner inside emoji."""
    if run[0] == "\u200c":
        return "\u200c" if before and _ARABIC_LETTER.match(before) and (_ARABIC_LETTER.match(after) or _CUT.match(after)) else ""
    after = after[:1]
    pictures = before and after and unicodedata.category(before)[0] in "SMC" and unicodedata.category(after)[0] == "S"
    return "\u200d" if pictures else ""


def _form(cluster: str, everywhere: dict[str, str]) -> str:
    """A cluster's form everywhere: its own, or of its longest known beginning with what follows."""
    form = everywhere.get(cluster)
    if form is not None or len(cluster) == 1:
        return cluster if form is None else form
    n = next((n for n in range(len(cluster) - 1, 1, -1) if cluster[:n] in everywhere), 1)
    return unicodedata.normalize("NFC", everywhere.get(cluster[:n], cluster[:n]) + "".join(everywhere.get(c, c) for c in cluster[n:]))


def unify(text: str | None) -> str | None:
    """``text`` in its one usual form; ASCII text, null and what only looks similar stay as they are."""
    if not text or text.isascii():
        return text
    table = _table()
    lookalikes = table.within[LATIN]
    clusters = _CLUSTER.findall(text) if _LONGER.search(text) else text
    if not _TELLING.search(text):
        return "".join(_form(c, table.everywhere) for c in clusters) if clusters is not text else text.translate(table.characters)
    around = Surroundings.of(text, lookalikes)
    forms = [f for f in (_form(c, table.everywhere) for c in clusters) if f]
    out: list[str] = []
    word: list[str] = []

    def write() -> None:
        script = _script(word, around, lookalikes, table)
        own = table.within[script] if script else {}
        out.extend("".join(own.get(c, c) for c in cluster) for cluster in word)
        word.clear()

    last = ""
    for k, form in enumerate(forms):
        if JOINERS[0] in form or JOINERS[1] in form:
            following = "".join(forms[k + 1 : k + 1 + AHEAD]).lstrip(JOINERS)
            parts, pieces = _JOINED.split(form), _JOINED.findall(form)
            # Joiners that end this cluster and begin the next are one run: the first of them speaks for all.
            form = parts[0]
            for run, part in zip(pieces, parts[1:]):
                before = (form or last)[-1:]
                form += ("" if before in JOINERS and before else _joiner(run, before, part or following)) + part
            if not form:
                continue
        last = form
        if form[0].isalpha() or word and form[0] in JOINERS:
            word.append(form)
            continue
        if word:
            write()
        out.append(form)
    if word:
        write()
    return "".join(out)
