"""Text that looks the same brought to one form: skeletons and canonical texts.

*Skeleton*: decompose (NFD), replace every character by the prototype of its look-alikes, decompose again. Two texts look the same if
their skeletons are equal; a skeleton is a key, not a text to show.

*Canonical text*: the plainest text of the same skeleton, its prototypes spelt in the alphabet of each word: width and font variants and
joined letters spelt out, invisible characters removed, every space the usual one, letter and accent composed, and letters of a foreign
alphabet within a word replaced by those of the word's own. Words wholly in one alphabet stay, as do superscripts, subscripts, fractions
and signs; small Greek letters beside Latin ones are taken for signs of formulas. A text that differs from its group's canonical text is a
case: some character of it stands where a plainer one would look the same.

The prototype table comes from rules over the Unicode character database (width, font, ligatures, Roman numerals, invisible signs,
spaces) plus groups of letters of Latin, Cyrillic, Greek, Armenian, Cherokee and Lisu; it is filled lazily. ``Lookalikes(groups)`` takes
more groups, ``confusables_file`` those of a file in the format of the public Unicode list.
Null texts give null; empty texts stay empty; texts are processed whole.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Groups of letters that look the same; the first one is the prototype of its group, Latin where there is one.
LOOKALIKES = (
    "aаα", "bᏏ", "cсϲ", "dԁᏧꓒ", "eе", "hһհ", "iіιᎥ", "jјϳ", "nո", "oоοօσ", "pрρ", "qԛ", "sѕ", "uսυ", "vѵν", "wԝ", "xх", "yуγᎩ", "lӏ", "кκ", "тτ",
    "AАΑᎪꓮ", "BВΒᏴꓐ", "CСϹᏟꓚ", "DᎠꓓ", "EЕΕᎬꓰ", "Fꓝ", "GԌᏀᏳꓖ", "HНΗᎻꓧ", "IІΙӀꓲ", "JЈᎫꓙ", "KКΚᏦꓗ", "LᏞꓡ", "MМΜᎷꓟ", "NΝꓠ", "OОΟՕꓳ", "PРΡᏢꓑ",
    "QԚ", "RᎡᏒꓣ", "SЅՏᏕᏚꓢ", "TТΤᎢꓔ", "UՍꓴ", "VѴᏙꓦ", "WԜᎳᏔꓪ", "XХΧꓫ", "YΥҮᎽꓬ", "ZΖᏃꓜ",
)
# Latin letters that look like plainer ones of their own alphabet.
VARIANTS = {"ɡ": "g", "ɑ": "a"}
# Letters of few languages; a word is never spelt with them instead of its other letters.
RARE = frozenset("ԁһԛԝѵӏԌԚԜѴӀ")
# small Greek letters that formulas use beside Latin letters
_FORMULA = frozenset("αγικνρστυ")

# Anything but printable ASCII, line breaks, the letters of the modern Cyrillic block and Ґ ґ, and common signs that stand for themselves
# needs the full treatment; an acute accent does if it follows no Cyrillic vowel.
_SUSPECT = re.compile("[^\\t\\n\\r\\x20-\\x7eЀ-џҐґ\u0301№·−√≈—–°½²³₀-₉…«»„“”’•]|(?<![аеиоуюяєіїэыАЕИОУЮЯЄІЇЭЫ])\u0301")
_WORD = re.compile(r"(?:[^\W_]|[̀-ͯ])+")
# of a text without suspects, a word of two alphabets: a Latin letter beside a Cyrillic one, signs of words between them or not
_BETWEEN = "[\\d\u0301²³₀-₉]*"
_MIXED = re.compile(f"[A-Za-z](?:(?={_BETWEEN}[Ѐ-џҐґ])|(?<=[Ѐ-џҐґ][A-Za-z])|(?<=[Ѐ-џҐґ][\\d\u0301²³₀-₉][A-Za-z])|(?<=[\\d\u0301²³₀-₉]{{2}}[A-Za-z]))")
# a word that holds letters of the Cyrillic block only
_ONE_ALPHABET = re.compile("[Ѐ-ӿ\u0300-\u036f\\d²³₀-₉½]+")


def _plain(ch: str) -> str:
    """What a single character stands for when it looks like plainer ones; itself otherwise."""
    cat = unicodedata.category(ch)
    cp = ord(ch)
    if cat == "Cf" or 0xFE00 <= cp <= 0xFE0F or 0xE0100 <= cp <= 0xE01EF or cp in (0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0):
        return ""
    if cat == "Cc":
        return ch if ch in "\t\n\r" else " " if ch in "\x0b\x0c\x85" else ""
    if cat in ("Zs", "Zl", "Zp"):
        return " "
    parts = unicodedata.decomposition(ch)
    if parts.startswith(("<wide>", "<narrow>")) or 0x1D400 <= cp <= 0x1D7FF or (cat == "Nl" and parts.startswith("<compat>")):
        return unicodedata.normalize("NFKC", ch)
    if parts.startswith(("<compat>", "<isolated>", "<initial>", "<medial>", "<final>")) and cat[0] == "L":
        spelt = unicodedata.normalize("NFKC", ch)
        if len(spelt) > 1 and spelt.isalpha():
            return spelt
    return VARIANTS.get(ch, ch)


class _Lazy(dict):
    def __init__(self, rule):
        super().__init__()
        self.rule = rule

    def __missing__(self, cp: int) -> str:
        self[cp] = out = self.rule(chr(cp))
        return out


@lru_cache(maxsize=1 << 16)
def _script(ch: str) -> str:
    return unicodedata.name(ch, "?").split(" ", 1)[0] if ch.isalpha() else ""


_plain_table = _Lazy(_plain)


class Lookalikes:
    """Skeletons and canonical texts by groups of letters that look the same: ``LOOKALIKES`` and ``groups``."""

    def __init__(self, groups: tuple[str, ...] = ()):
        self.groups = groups
        self.prototype: dict[str, str] = {}
        self.letters: dict[str, dict[str, str]] = {}  # prototype -> alphabet -> its letter
        for group in (*LOOKALIKES, *groups):
            first = self.prototype.get(group[0], group[0])
            for x in group:
                if x != first:
                    self.prototype.setdefault(x, first)
                if x not in RARE:
                    self.letters.setdefault(first, {}).setdefault(_script(x), x)
        self._table = _Lazy(lambda ch: "".join(self.prototype.get(c, c) for c in _plain(ch)))

    def __reduce__(self):
        return Lookalikes, (self.groups,)

    def skeleton(self, text: str | None) -> str | None:
        if text is None:
            return None
        n = unicodedata.normalize
        return n("NFD", n("NFD", text).translate(self._table))

    def _spelt(self, word: str) -> str:
        """The word's skeleton in its own alphabet: letters of foreign alphabets give way to those of the same prototype, as far as there are any.

        Its own alphabet is Latin or Cyrillic if the word has letters of these: that with most letters which the other one lacks, then
        with most letters, then the first. A third alphabet needs more letters than these and one that neither has: a Greek sign beside
        Latin letters does not make them Greek.
        """
        held: dict[str, list[tuple[int, str]]] = {}
        for i, ch in enumerate(word):
            if s := _script(ch):
                base = unicodedata.normalize("NFD", ch)[0]
                held.setdefault(s, []).append((i, self.prototype.get(base, base)))
        if len(held) < 2:
            return word
        near = {"LATIN", "CYRILLIC"}
        firm = {s: sum(all(o == s or o not in self.letters.get(p, ()) for o in near) for _, p in found) for s, found in held.items()}
        most = max((len(held[s]) for s in near & held.keys()), default=0)
        able = [s for s in held if s in near or (firm[s] and len(held[s]) > most)] or list(held)
        own = max(able, key=lambda s: (firm[s], len(held[s]), -held[s][0][0]))
        out = list(word)
        for s, found in held.items():
            for i, p in found if s != own else ():
                if own != "LATIN" or word[i] not in _FORMULA:
                    d = unicodedata.normalize("NFD", word[i])
                    out[i] = self.letters.get(p, {}).get(own, d[0]) + d[1:]
        return unicodedata.normalize("NFC", "".join(out))

    def canonical(self, text: str | None) -> str | None:
        if not text:
            return text
        suspect = _SUSPECT.search(text)
        if not suspect and not _MIXED.search(text):
            return text
        s = unicodedata.normalize("NFC", text.translate(_plain_table)) if suspect else text
        if not s.isascii():
            words_ = {w for w in _WORD.findall(s) if not w.isascii()}
            swaps = {w: o for w in words_ if not _ONE_ALPHABET.fullmatch(w) and (o := self._spelt(w)) != w}
            if swaps:
                s = _WORD.sub(lambda m: swaps.get(m[0], m[0]), s)
        return s

    def plainer(self, text: str | None) -> bool:
        """Whether the text is not the canonical one of its skeleton group."""
        return bool(text) and (c := self.canonical(text)) != text and self.skeleton(c) == self.skeleton(text)

    def forms(self, text: str | None) -> tuple[str | None, str | None, bool]:
        if text is None:
            return None, None, False
        k, c = self.skeleton(text), self.canonical(text)
        return k, c, c != text and self.skeleton(c) == k


def confusables_file(path: str) -> tuple[str, ...]:
    """Groups from a file in the format of the public Unicode list of confusables (``source ; target ; type # comment``, code points in hex).

    Only pairs of single letters of different alphabets are taken: others say that signs or several letters look alike, which no word's
    alphabet settles.
    """
    out = []
    with open(path, encoding="utf-8-sig") as f:
        for line in f:
            parts = [x.strip() for x in line.split("#", 1)[0].split(";")]
            if len(parts) >= 2 and " " not in parts[0] + parts[1] and parts[0]:
                a, b = (chr(int(x, 16)) for x in parts[:2])
                if a.isalpha() and b.isalpha() and _script(a) != _script(b):
                    out.append(b + a)
    return tuple(out)


_DEFAULT = Lookalikes()
skeleton, canonical, has_lookalike = _DEFAULT.skeleton, _DEFAULT.canonical, _DEFAULT.plainer

_PUNCT_MARKS = re.compile(r"[̀-ͯ]+")
_TOKEN = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    """Words as read by eye: canonical, lower case, without punctuation, spacing and accents that have no composed form."""
    if not text:
        return []
    s = canonical(text).lower()
    return _TOKEN.findall(s if s.isascii() else _PUNCT_MARKS.sub("", s))


_FORMS = T.StructType([T.StructField("skeleton", T.StringType()), T.StructField("canonical", T.StringType()), T.StructField("lookalike", T.BooleanType())])


def forms(text: Column, table: Lookalikes = _DEFAULT) -> Column:
    """struct(skeleton, canonical, lookalike) of a text column."""

    @F.pandas_udf(_FORMS)
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([table.forms(t) for t in texts], columns=["skeleton", "canonical", "lookalike"])

    return run(text)


def lookalike(text: Column, table: Lookalikes = _DEFAULT) -> Column:
    @F.pandas_udf(T.BooleanType())
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([table.plainer(t) for t in texts], dtype=bool)

    return run(text)


def skeleton_groups(df: DataFrame, id_col: str, text: str = "text") -> DataFrame:
    """(``skeleton_md5``, ``rows``, ``variants``, ``first_id``): the texts of equal skeleton, with how many rows and different texts.

    Only hashes and ids are shuffled, never texts, and equal texts are counted before they are: a text that is a third of all rows is a
    handful of rows by then. ``first_id`` names a row of the group to read its text from (null if no row of it has an id). Null texts
    belong to no group, the empty text to its own.
    """
    made = df.where(F.col(text).isNotNull()).select(F.col(id_col).alias("__id"), F.md5(F.col(text).cast("binary")).alias("__t"), F.md5(forms(F.col(text))["skeleton"].cast("binary")).alias("skeleton_md5"))
    texts = made.groupBy("skeleton_md5", "__t").agg(F.count("*").alias("__n"), F.min("__id").alias("__id"))
    return texts.groupBy("skeleton_md5").agg(F.sum("__n").alias("rows"), F.count("*").alias("variants"), F.min("__id").alias("first_id"))
