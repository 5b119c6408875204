"""Text analysis: tokens as columns, and stems and edit distances for vocabularies."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


#: Private characters begin here.
_HIDDEN = 0xF0000


def _char_class(chars: str) -> str:
    return "".join("\\" + c if c in "\\[]^-&~" else c for c in dict.fromkeys(chars))


def fold(word: Column) -> Column:
    """Case folding: lower case, with the letters whose folded form is another."""
    return F.replace(F.replace(F.lower(word), F.lit("ß"), F.lit("ss")), F.lit("ς"), F.lit("σ"))


def fold_word(word: str) -> str:
    return word.lower().replace("ß", "ss").replace("ς", "σ")


def tokens(text: Column, punctuation: str, stop_words: tuple[str, ...]) -> Column:
    """The words of a text in order, without stop words; a null text has none (null).

    White space, control characters and punctuation separate words; a backslash keeps the
    punctuation character that follows. All of it is one pass of built-in functions.
    """
    chars = "".join(dict.fromkeys([*punctuation, *map(chr, range(33)), chr(127)]))
    breaks = _char_class(punctuation) + "\\x00-\\x20\\x7f"
    # escaped characters become private ones and back: a pattern of nested repetition would recurse once for each character
    hidden = "".join(chr(_HIDDEN + ord(c)) for c in chars)
    pair = f"\\\\[{breaks}\\\\]" if "\\" in punctuation else r"\\(?s:.)"
    pieces = F.regexp_extract_all(text, F.lit(f"{pair}|[^\\\\]+|\\\\"), F.lit(0))
    shown = F.array_join(F.transform(pieces, lambda p: F.when(F.startswith(p, F.lit("\\")) & (F.char_length(p) == 2), F.translate(F.substring(p, 2, 1), chars, hidden)).otherwise(p)), "")
    escaped = F.contains(text, F.lit("\\"))
    words = F.regexp_extract_all(F.when(escaped, shown).otherwise(text), F.lit(f"[^{breaks}]+"), F.lit(0))
    words = F.when(escaped, F.transform(words, lambda w: F.translate(w, hidden, chars))).otherwise(words)
    words = F.transform(words, fold)
    return F.filter(words, lambda w: ~w.isin(*stop_words)) if stop_words else words


_VOWELS = "aeiouy"
_DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
#: Fixed values of the English stemmer: irregular words, and words left as they are after its second step.
_IRREGULAR = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli",
    "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
_KEPT = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
_STEP2 = {
    "ization": "ize", "ational": "ate", "fulness": "ful", "ousness": "ous", "iveness": "ive", "tional": "tion", "biliti": "ble", "lessli": "less", "entli": "ent",
    "ation": "ate", "alism": "al", "aliti": "al", "ousli": "ous", "iviti": "ive", "fulli": "ful", "enci": "ence", "anci": "ance", "abli": "able", "izer": "ize",
    "ator": "ate", "alli": "al", "bli": "ble",
}
_STEP3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic")


def _regions(w: str) -> tuple[int, int]:
    """Where the stemmer's regions R1 and R2 begin."""

    def after(at: int) -> int:
        m = re.compile(r"[aeiouy][^aeiouy]").search(w, at)
        return m.end() if m else len(w)

    head = re.match(r"gener|commun|arsen", w)
    r1 = head.end() if head else after(0)
    return r1, after(r1)


def _short(w: str, r1: int) -> bool:
    return r1 >= len(w) and bool(re.search(r"(?:^[aeiouy][^aeiouy]|[^aeiouy][aeiouy][^aeiouywxY])$", w))


def stem(word: str) -> str:
    """The English (Porter 2) stem of a lower-case word."""
    if len(word) <= 2:
        return word
    if word in _IRREGULAR:
        return _IRREGULAR[word]
    w = word[1:] if word[0] == "'" else word
    w = re.sub(r"^y|(?<=[aeiouy])y", "Y", w)
    r1, r2 = _regions(w)
    w = re.sub(r"'s'$|'s$|'$", "", w)
    # plurals
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search(r"[aeiouy].", w[:-1]):
        w = w[:-1]
    if w in _KEPT:
        return w.lower()
    # past tenses and participles
    if w.endswith(("eed", "eedly")):
        cut = 5 if w.endswith("eedly") else 3
        if len(w) - cut >= r1:
            w = w[:-cut] + "ee"
    elif m := re.search(r"(?:ingly|edly|ing|ed)$", w):
        if re.search(r"[aeiouy]", w[: m.start()]):
            w = w[: m.start()]
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif w.endswith(_DOUBLES):
                w = w[:-1]
            elif _short(w, r1):
                w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _VOWELS:
        w = w[:-1] + "i"
    # derived forms
    for suffix in sorted([*_STEP2, "ogi", "li"], key=len, reverse=True):
        if w.endswith(suffix):
            if len(w) - len(suffix) >= r1:
                if suffix == "ogi":
                    w = w[:-1] if w.endswith("logi") else w
                elif suffix == "li":
                    w = w[:-2] if w[-3:-2] and w[-3] in "cdeghkmnrt" else w
                else:
                    w = w[: -len(suffix)] + _STEP2[suffix]
            break
    for suffix in sorted([*_STEP3, "ative"], key=len, reverse=True):
        if w.endswith(suffix):
            if suffix == "ative":
                w = w[:-5] if len(w) - 5 >= r2 else w
            elif len(w) - len(suffix) >= r1:
                w = w[: -len(suffix)] + _STEP3[suffix]
            break
    for suffix in sorted([*_STEP4, "ion"], key=len, reverse=True):
        if w.endswith(suffix):
            if len(w) - len(suffix) >= r2 and (suffix != "ion" or w[-4:-3] in ("s", "t")):
                w = w[: -len(suffix)]
            break
    if w.endswith("e"):
        bare = w[:-1]
        if len(bare) >= r2 or len(bare) >= r1 and not re.search(r"(?:^[aeiouy][^aeiouy]|[^aeiouy][aeiouy][^aeiouywxY])$", bare):
            w = bare
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.lower()


def osa_within(a: bytes, b: bytes, limit: int) -> bool:
    """Whether at most `limit` insertions, deletions, changes and swaps of neighbours (no part edited twice) turn a into b."""
    if abs(len(a) - len(b)) > limit:
        return False
    before, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i] + [0] * len(b)
        for j, y in enumerate(b, 1):
            new[j] = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y))
            if before is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                new[j] = min(new[j], before[j - 2] + 1)
        if min(new) > limit and min(row) > limit:
            return False
        before, row = row, new
    return row[-1] <= limit


def stem_column(word: Column) -> Column:
    @F.pandas_udf("string")
    def stems(words: pd.Series) -> pd.Series:
        return words.map(stem, na_action="ignore")

    return stems(word)


def within_column(word: Column, target: str, limit: int) -> Column:
    goal = target.encode()

    @F.pandas_udf("boolean")
    def near(words: pd.Series) -> pd.Series:
        return words.map(lambda w: osa_within(w.encode(), goal, limit))

    return near(word)


def words_column(words: Column, test: Callable[[str], bool]) -> Column:
    """Of an array of words those that pass, in Python; few words should get here."""

    @F.pandas_udf("array<string>")
    def passing(lists: pd.Series) -> pd.Series:
        known: dict[str, bool] = {}

        def passes(w: str) -> bool:
            if w not in known:
                known[w] = test(w)
            return known[w]

        return lists.map(lambda ws: [w for w in ws if passes(w)] if ws is not None and len(ws) else [])

    return passing(words)


def any_order(parts: list[list[tuple[int, int]]], slop: int) -> list[tuple[int, int]]:
    """Where all parts stand in some order, one after the other, with at most slop words between the first's beginning and the last's besides theirs.

    parts: each one's (beginning, end) places. For each beginning the earliest end: over the
    places from there on in order, for every set of parts that can be placed so far, the least end.
    """
    places = sorted((s, e, k) for k, part in enumerate(parts) for s, e in part)
    every, out = (1 << len(parts)) - 1, {}
    for i, (start, end, k) in enumerate(places):
        ends = {1 << k: end}
        for s, e, j in places[i + 1 :]:
            if s > start + slop + len(parts) - 1:
                break
            for held, last in list(ends.items()):
                if not held >> j & 1 and s > last and e < ends.get(held | 1 << j, e + 1):
                    ends[held | 1 << j] = e
        if every in ends:
            out[start] = min(ends[every], out.get(start, ends[every]))
    return sorted(out.items())


def any_order_column(parts: list[Column], slop: int) -> Column:
    """any_order() of arrays of (s, e) structs."""

    @F.pandas_udf("array<struct<s:int,e:int>>")
    def near(*columns: pd.Series) -> pd.Series:
        def of(row: tuple) -> list[dict]:
            lists = [() if x is None else x for x in row]
            places = [list(zip(map(int, lists[i]), map(int, lists[i + 1]), strict=True)) for i in range(0, len(lists), 2)]
            return [{"s": s, "e": e} for s, e in any_order(places, slop)] if all(places) else []

        return pd.Series([of(r) for r in zip(*columns, strict=True)])

    return near(*(c for p in parts for c in (F.transform(p, lambda x: x["s"]), F.transform(p, lambda x: x["e"]))))
