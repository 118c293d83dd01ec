"""Garbled text from wrong character encoding (problem 10)."""

from __future__ import annotations

import math
import re
import string
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Single-byte encodings in which UTF-8 bytes may have been read.
READ_AS = ("latin-1", "cp1252", "iso8859-15", "cp1250", "iso8859-2", "cp1251", "cp1254", "koi8-r", "cp866", "cp437", "cp850", "mac_roman", "iso8859-7", "cp1253", "cp1255", "cp1256", "cp1257", "mac_cyrillic")
#: Multi-byte encodings in which UTF-8 bytes of Western text may have been read.
READ_WIDE = ("gbk", "cp932", "euc_kr", "big5")
#: Readings in which texts of this kind are seldom written, so a weak sequence counts beside a sure one anywhere in the text.
RARELY = ("iso8859-7", "cp1253", "cp1255", "cp1256")
#: Pairs (written in, read as) of single-byte encodings of Western and Central European text.
WESTERN = [(a, b) for a in ("cp1252", "cp437", "cp850", "mac_roman") for b in ("cp1252", "latin-1", "cp437", "cp850", "mac_roman") if a != b and {a, b} != {"cp1252", "latin-1"}]
WESTERN += [("cp1252", b) for b in ("cp1251", "koi8-r", "cp866", "mac_cyrillic", "iso8859-5", "cp1253", "iso8859-7", "cp1255", "cp1256")]
WESTERN += [(a, b) for a in ("iso8859-2", "cp1250") for b in ("cp1252", "latin-1", "cp437", "cp850", "cp1251")]
#: Encodings of Cyrillic text, written or read.
CYRILLIC = ("cp1251", "koi8-r", "cp866", "iso8859-5", "mac_cyrillic")
#: Multi-byte encodings that may have been read as Western text.
JAPANESE = ("shift_jis", "euc_jp")

#: Accented letters of Western languages.
LETTERS = "àáâãäåæçèéêëìíîïñòóôõöøùúûüýÿßœÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝŒ"
#: Russian letters, from frequent to rare, with their share in a thousand letters.
RUSSIAN = dict(zip("оеаинтсрвлкмдпуяыьгзбчйхжшюцщэфъё", (110, 85, 80, 74, 67, 63, 55, 47, 45, 44, 35, 32, 30, 28, 26, 20, 19, 17, 17, 17, 16, 14, 12, 10, 9, 7, 6, 5, 4, 3, 3, 1, 1)))
#: Greek, Hebrew and Arabic letters, from frequent to rare, with their share in a thousand letters.
GREEK = dict(zip("αοιετσνηυρπκμλςωδγήίόάχθφέβώύξζψϊϋΐΰ", (98, 90, 77, 75, 77, 48, 62, 45, 40, 40, 40, 38, 33, 26, 38, 18, 16, 16, 18, 24, 20, 22, 12, 12, 8, 17, 7, 8, 10, 4, 3, 2, 1, 1, 1, 1)))
HEBREW = dict(zip("יוהלארתבשמנםכעדקחפןגסטזצךץף", (110, 103, 108, 74, 64, 60, 51, 47, 44, 46, 29, 27, 24, 33, 26, 22, 25, 17, 13, 13, 15, 13, 14, 13, 9, 2, 3)))
ARABIC = dict(zip("اليمنرتوبعدسفهكحقجأةشصطىخذثزضغءئإؤظآ", (125, 118, 68, 61, 58, 42, 45, 56, 35, 35, 28, 26, 26, 26, 22, 22, 22, 13, 17, 15, 10, 9, 10, 8, 8, 6, 6, 5, 5, 4, 3, 3, 6, 1, 2, 3)))
#: Encodings of each script with the letters by which its texts are told.
SCRIPTS = [(written, letters) for some, letters in ((CYRILLIC, RUSSIAN), (("cp1253", "iso8859-7"), GREEK), (("cp1255", "iso8859-8"), HEBREW), (("cp1256", "iso8859-6"), ARABIC)) for written in some]
#: Marks that may rightly stand between letters, as in units and formulas.
BETWEEN = "·×°®™©²³¹±/µ§"
#: Quotes, dashes and closing marks that may rightly follow a capital letter.
CLOSING = "“”‘’»«›‹–—…"


def _read(data: bytes, codec: str) -> str:
    """Decode as programs do: bytes that the encoding leaves open become control characters."""
    return "".join(chr(b) if (c := bytes([b]).decode(codec, "replace")) == "�" else c for b in data)


def _plain_chars() -> str:
    """Characters that texts are expected to hold, by range."""
    ranges = [(0xA0, 0x180), (0x192, 0x193), (0x2C6, 0x2C7), (0x2DC, 0x2DD), (0x386, 0x3CF), (0x401, 0x402), (0x410, 0x452), (0x5D0, 0x5EB), (0x621, 0x64B)]
    ranges += [(0x2010, 0x2028), (0x202F, 0x2040), (0x2070, 0x208F), (0x20AC, 0x20AD), (0x2122, 0x2123), (0x2190, 0x2196), (0x2200, 0x2266), (0x2460, 0x2474), (0x3000, 0x3030), (0x3041, 0x3097), (0x30A0, 0x3100), (0xE01, 0xE5C), (0xFB00, 0xFB05), (0xFF01, 0xFF5F), (0x1F300, 0x1F650), (0x1F900, 0x1F9FF)]
    chars = [chr(c) for a, b in ranges for c in range(a, b)] + ["�", "﻿", "​", "‍"]
    # The common ideographs: the first levels of the Japanese and the Chinese standard.
    for c in map(chr, range(0x4E00, 0xA000)):
        if any((b := c.encode(codec, "ignore")) and b[0] <= last for codec, last in (("shift_jis", 0x97), ("gb2312", 0xD7))):
            chars.append(c)
    return "".join(chars)


def _weak(garbled: str, codec: str) -> bool:
    """Whether a sequence could also stand in sound text, so that it counts only next to another."""
    if len(garbled) > 2:
        return False
    a, b = garbled[0], garbled[-1]
    if codec in ("cp1251", "koi8-r", "cp866", "mac_cyrillic", "iso8859-7", "cp1253", "cp1255", "cp1256", "cp1257"):
        return b.isalpha() or b in CLOSING + "°№\xa0"
    return a.isalpha() and a not in "ÃÂ" and (b in CLOSING or (b.isalpha() and b not in "ªºµƒ" and a != "Ă"))


@lru_cache(1)
def _automaton():
    """Garbled sequences of all plain characters in UTF-8 for all readings: what stood there, whether it is weak, and the pair."""
    import ahocorasick

    table: dict[str, tuple[str, bool | None, str]] = {}
    for codec in READ_AS:
        for char in _plain_chars():
            seen = _read(char.encode(), codec)
            table.setdefault(seen, (char, _weak(seen, codec), f"utf-8>{codec}"))
    for codec in ("cp1252", "latin-1"):
        for char in map(chr, range(0x80, 0xA0)):  # halves of characters that were garbled before
            seen = _read(char.encode(), codec)
            table.setdefault(seen, (char, False, f"utf-8>{codec}"))
    for codec in READ_WIDE:
        for char in LETTERS + "’“”–—…":
            for after in ["", *string.ascii_lowercase, " "]:
                try:
                    seen = (char + after).encode().decode(codec)
                except UnicodeDecodeError:
                    continue
                table.setdefault(seen, (char + after, None, f"utf-8>{codec}"))  # None: counts only within a word
                if not after:
                    break
    automaton = ahocorasick.Automaton()
    for seen, (char, weak, pair) in table.items():
        if not seen.isascii() and seen != char:
            automaton.add_word(seen, (len(seen), char, weak, pair))
    automaton.make_automaton()
    return automaton


@lru_cache(1)
def _western():
    """(automaton, pairs): letters of Western text read in another single-byte encoding, in the contexts in which only a letter can stand.

    It works on a shadow of the text: small letters are a, capitals A, digits 9, white space and
    punctuation a space; all other characters stand for themselves.
    """
    import ahocorasick

    automaton, contexts = ahocorasick.Automaton(), {}
    for written, read in WESTERN:
        letters = LETTERS if written not in ("iso8859-2", "cp1250") else [c for b in range(0x80, 0x100) if (c := _read(bytes([b]), written)).isalpha()]
        for letter in letters:
            try:
                seen = _read(letter.encode(written), read)
            except UnicodeEncodeError:
                continue
            if seen == letter or seen in "…–—’‘'" or seen.isspace():
                continue
            around = []
            if not seen.isalpha() and seen not in "ªº²":  # a mark between letters, or at the end of a word
                around = [f"a{seen}a"]
                if seen in "≤≥⌠⌡∩≡≈∞÷■▀▄█▌▐¾¶¦¤" or 0x2500 <= ord(seen) < 0x25A0:
                    around += [f"aa{seen} ", f" {seen}aa"]
            elif seen.isalpha() and not unicodedata.name(seen, "").startswith("LATIN"):  # a letter of another script inside a word
                around = [f"a{seen}a"]
                if written != "cp1252" or read in ("cp437", "cp850", "mac_roman"):
                    around += [f"aa{seen} "] + ([f" {seen}aa"] if seen not in "αβγδεκλµ" else [])
            elif seen.isalpha() and seen not in LETTERS + "ªº²":  # Latin letters of other languages: they only follow a sure hit
                around = [f"a{seen}a", f"aa{seen} ", f" {seen}aa"] if not (seen.isupper() and letter.islower()) else [f"a{seen}a"]
            elif seen.isupper() and letter.islower():
                around = [f"a{seen}a"]
            elif seen == "ß":
                around = [f" {seen}aa"]
            foreign = seen.isalpha() and seen.islower() and seen not in LETTERS + "ªº²" and unicodedata.name(seen, "").startswith("LATIN")
            weak = foreign or seen in BETWEEN
            for c in around:
                contexts.setdefault(c, []).append((c.index(seen), f"{written}>{read}", letter, weak))
    for c, found in contexts.items():
        automaton.add_word(c, (len(c), found))
    automaton.make_automaton()
    return automaton, [f"{written}>{read}" for written, read in WESTERN]


_SHADOW = {**{ord(c): "a" for c in "abcdefghijklmnopqrstuvwxyz"}, **{ord(c): "A" for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}, **{ord(c): "9" for c in "0123456789"}}
_SHADOW |= {c: " " for c in range(128) if c not in _SHADOW} | {0xA0: " "}
_CONTROL = re.compile("[\x80-\x84\x86-\x9f�]")
_NOT_ASCII = re.compile(r"[^\s\x00-\x7f]+")
#: Runs of accented letters without plain ones: Cyrillic read as Western text.
_RUN = re.compile("(?<![A-Za-z])[À-ÿ¨¸¥³²´¿¯ºª¹¡¢£]{3,}(?![A-Za-z])")
#: Letters of such runs that stand as a word of any length.
_SHORT_RUN = re.compile(r"(?<![^\s(«\"“—–-])[À-ÿ¨¸]+(?![^\s.,;:!?)»\"”—–-])")
_CYRILLIC_WORD = re.compile("[Ѐ-ҁҐґ─-╿°·√■\xa0№¤§©«»¬®±µ¶€Ѐ-џ]*[А-яЁё][Ѐ-ҁҐґ─-╿°·√■№¤§©¬®±µ¶€]*")


#: Stretches without plain white space: no-break space and next line may be halves of characters.
_TOKEN = re.compile(r"[^ \t\r\n\f\v]+")
#: What a stretch of Japanese read as Western text holds at least: leading bytes of kana, or of kanji in a row.
_LEADS = re.compile("[‚ƒ\x81-\x83\x88-\x97]|[¤¥][¡-þ]|[ÇÉ][^ ]*[ÇÉ]|[§•][^ ]+[§•]|(?:[°-Ï][¡-þ]){2}|(?:[ˆ‰Š‹ŒŽ‘’“”•–—].){2}|(?:[∞±≤≥¥µ∂∑∏π∫ªºΩæø¿¡¬√ƒ≈∆«»…\xa0ÀÃÕŒœ].){3}")
_HIGH_RUN = re.compile(b"[\x80-\xff]+")
_UTF8 = re.compile(b"[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}")
_TWICE = re.compile(b"[\xc2\xc3]{1,2}[\x80-\xbf]")
#: Encodings with the characters that vendors added.
_VENDOR = {"shift_jis": "cp932", "euc_jp": "euc_jis_2004"}
_WIDE_MARKS = frozenset(map(chr, [*range(0x3000, 0x3040), *range(0x30FB, 0x3100), *range(0xFF01, 0xFF5F), *range(0x2460, 0x2474)])) | set("—‐―…‥‘’“”×÷±°′″℃→←↑↓○●◎△▲□■☆★※〒−∥")


@lru_cache(1)
def _common_kanji() -> frozenset[str]:
    """Kanji of the first level of the Japanese standard."""
    return frozenset(c for c in map(chr, range(0x4E00, 0xA000)) if (b := c.encode("euc_jp", "ignore")) and len(b) == 2 and b[0] <= 0xCF)


def _russian(s: str, letters: dict[str, int] = RUSSIAN) -> float:
    """Mean logarithmic score of a string by the shares of its letters, Russian if none are given; wrong case and other characters count against it."""
    total, n = 0.0, 0
    for i, c in enumerate(s):
        share = letters.get(c.lower())
        n += 1
        total += math.log(share) if share else -4.0
        if i and c.isupper() and s[i - 1].islower():
            total -= 2.0
    return total / max(n, 1)


def _rewritten(s: str, read: str, written: str) -> str | None:
    try:
        return s.encode(read).decode(written)
    except (UnicodeEncodeError, UnicodeDecodeError):
        return None


def _utf8_pass(text: str) -> tuple[str, int]:
    """Replace garbled multi-byte sequences once; also how many were replaced."""
    found = []
    for end, (n, char, weak, pair) in _automaton().iter_long(text):
        found.append((end - n + 1, end + 1, char, weak, pair))
    if not found:
        return text, 0
    # Encodings share sequences, so any neighbour will do.
    beside = [i > 0 and found[i - 1][1] == x[0] for i, x in enumerate(found)] + [False]
    frame = lambda a, b: b - a == 2 and text[a] in "├┬" and 0x2500 <= ord(text[b - 1]) < 0x2580
    plain = {x[4] for x in found if x[3] is False and not frame(x[0], x[1])}
    small = lambda i: 0 <= i < len(text) and "a" <= text[i] <= "z"
    inside = {x[4] for x in found if x[3] is None and small(x[0] - 1) and small(x[1])}
    # Two scripts in a word, or a capital after a small letter and before a mark.
    other = lambda c: c.isalpha() and not unicodedata.name(c, "").startswith("LATIN")
    mixed = lambda a, b: (other(text[a]) and (small(a - 1) or small(b))) or (text[a].isupper() and small(a - 1) and text[b - 1] in CLOSING)
    certain = plain | {x[4] for x in found if x[3] and mixed(x[0], x[1])}
    out, at, n = [], 0, 0
    for i, (a, b, char, weak, pair) in enumerate(found):
        if weak is None:
            if pair not in inside or not (small(a - 1) or small(b)):
                continue
        elif weak:
            alone = text[a] in "ÐÑ" and not (a and text[a - 1].isalpha())
            if not (beside[i] or beside[i + 1] or mixed(a, b) or (pair in certain and (alone or pair.endswith(RARELY)))):
                continue
        elif frame(a, b):
            if not (pair in plain or (a and text[a - 1].isalpha()) or (b < len(text) and text[b].isalpha())):
                continue  # it may be a drawn frame
        elif text[a] in "ÃÂ" and text[b - 1] in CLOSING and b - a == 2 and a and text[a - 1].isupper() and text[a - 1].isascii():
            continue
        out += [text[at:a], char]
        at, n = b, n + 1
    return "".join([*out, text[at:]]), n


@lru_cache(None)
def _bytes_of(read: str) -> dict[str, int]:
    """The byte that each character was read from; of two bytes with one character the first."""
    return {_read(bytes([b]), read): b for b in range(255, -1, -1)}


def _characters(data: bytes, written: str) -> list[tuple[int, str]]:
    """(length, character) of data written in a Japanese encoding; an empty character where no character begins."""
    out, at = [], 0
    while at < len(data):
        if data[at] < 0x80:
            out.append((1, chr(data[at])))
            at += 1
            continue
        for n, codec in ((2, written), (2, _VENDOR[written]), (1, written), (3, written)):
            try:
                char = data[at : at + n].decode(codec)
            except UnicodeDecodeError:
                continue
            if len(char) == 1:
                break
        else:
            n, char = 1, ""
        out.append((n, char))
        at += n
    return out


def _utf8_like(s: str) -> bool:
    """Whether the characters beyond ASCII look like UTF-8 in one of its readings, once or twice over."""
    for read in READ_AS:
        of = _bytes_of(read)
        data = bytes(of.get(c) or (ord(c) if c < "\xa0" else 0) for c in s)
        high = sum(c > "\x7f" for c in s)
        if sum(map(len, _UTF8.findall(data))) > 0.85 * high or sum(map(len, _TWICE.findall(data))) >= 0.5 * high:
            return True
    return False


def _japanese_pass(text: str) -> tuple[str, int]:
    """Decode whole stretches of Japanese text read in a Western encoding; also how many were decoded."""
    if not _LEADS.search(text):
        return text, 0
    tokens = [m for m in _TOKEN.finditer(text) if _LEADS.search(m.group())]
    spans: dict[tuple[int, int], list] = {}
    for read in ("cp1252", "latin-1", "mac_roman"):
        of = _bytes_of(read)
        for token in tokens:
            # A stretch ends at characters that no byte was read as, so sound Japanese stays outside.
            at = token.start()
            for held, part in groupby(token.group(), key=lambda c: c in of):
                n = len(list(part))
                data = bytes(of[c] for c in text[at : at + n]) if held else b""
                at += n
                if data.isascii():
                    continue
                for written in JAPANESE:
                    chars = _characters(data, written)
                    wide = [c for _, c in chars if not c.isascii() and not "｡" <= c <= "ﾟ"]
                    other = sum(not c or "｡" <= c <= "ﾟ" for _, c in chars)
                    if not wide or other * 4 > len(wide):
                        continue
                    kana = sum("ぁ" <= c <= "ー" for c in wide)
                    common = sum(c in _common_kanji() for c in wide)
                    rare = len(wide) - kana - common - sum(c in _WIDE_MARKS for c in wide)
                    # Letters of Western words seldom follow one another, those of kanji always do.
                    joined = max((len(m) for m in _HIGH_RUN.findall(data)), default=0)
                    sure = kana >= 2 and rare * 4 <= len(wide)
                    if written == "euc_jp":
                        letters = sum(c in "×÷" or c.isalpha() for c in text[at - n : at] if c > "\x7f")
                        runs = _RUN.findall(text, at - n, at)
                        russian = any(sum(len(r) for r in runs if (x := _rewritten(r, read, c)) and _russian(x) >= 2.2) * 4 >= 3 * (len(data) - sum(b < 0x80 for b in data)) for c in ("cp1251", "koi8-r"))
                        sure = sure or (not rare and not other and common >= (2 if read != "mac_roman" else 3) and joined >= 4 and 2 * letters >= joined and not russian)
                    elif read != "mac_roman":
                        controls = len(_CONTROL.findall(text, at - n, at))
                        sure = sure or (not rare and not other and common >= (2 if controls else 3) and (controls or joined >= 3))
                    kin = not rare and not other and (kana or (common >= 1 and read != "mac_roman"))
                    if (sure or kin) and not _utf8_like(text[at - n : at]):
                        spans.setdefault((at - n, at), []).append((sure, kana + common - 2 * rare - 2 * other, f"{written}>{read}", chars))
    pairs = Counter(pair for found in spans.values() for sure, _, pair, _ in found if sure)
    out, last, n = [], 0, 0
    for (a, b), found in sorted(spans.items()):
        found = [x for x in found if x[2] in pairs]
        if a < last or not found:
            continue
        chars, back, at = max(found, key=lambda x: (x[0], x[1], pairs[x[2]]))[3], [], a
        for size, char in chars:
            back.append(char or text[at : at + size])
            at += size
        out += [text[last:a], "".join(back)]
        last, n = b, n + 1
    return "".join([*out, text[last:]]), n


@lru_cache(None)
def _western_map(pair: str) -> dict[str, str]:
    """All characters that the written encoding holds, by what they were read as."""
    written, read = pair.split(">")
    chars = [(_read(bytes([b]), read), _read(bytes([b]), written)) for b in range(0x80, 0x100)]
    return {seen: char for seen, char in chars if seen != char and not "\x80" <= char < "\xa0"}


@lru_cache(1)
def _symbols() -> list[tuple[re.Pattern, dict[str, set[str]]]]:
    """Symbols of Western text in contexts of their own: a pattern, and the pairs in which its character stands for that symbol."""
    out = []
    for char, before, after in (("°", r"(?<=\d)[ \xa0]?", r"(?=C(?!\w))"), ("µ", r"(?<=\d)[ \xa0]", r"(?=[MLlgms](?!\w))"), ("’", r"(?<=[A-Za-z0-9])", r"(?=s(?!\w))")):
        seen: dict[str, set[str]] = {}
        for pair in (f"{w}>{r}" for w, r in WESTERN):
            for x, c in _western_map(pair).items():
                # What sound text has there: other marks of degree, micro and apostrophe, and small letters within words.
                if c == char and x not in "°º˚µμ’‘'´\xa0" and not (char == "’" and (x.islower() or not x.isprintable())):
                    seen.setdefault(x, set()).add(pair)
        out.append((re.compile(f"{before}([{re.escape(''.join(seen))}]){after}"), seen))
    return out


@lru_cache(1)
def _quotes() -> list[tuple[re.Pattern, set[str]]]:
    """Quotes around words that were read as letters."""
    out: dict[str, set[str]] = {}
    for pair in (f"{w}>{r}" for w, r in WESTERN):
        seen = {c: x for x, c in _western_map(pair).items()}
        a, b = seen.get("“", ""), seen.get("”", "")
        if a.isalpha() and b.isalpha():
            out.setdefault(rf"(?<!\w){a}(?=[A-Za-z0-9][^{a}{b}\n]{{0,80}}[a-z0-9.,!?]{b}(?!\w))", set()).add(pair)
    return [(re.compile(k), v) for k, v in out.items()]


def _sound(c: str, before: str, after: str) -> float:
    """How well a character stands between its neighbours in Western text."""
    low = before.islower() or after.islower()
    within = before.isalpha() and after.isalpha()
    if c in LETTERS:
        if c.islower():
            if before.isupper() and after.isupper():
                return -1.0
            return 1.3 if c in "éèàçêüäößñóáíã" else 1.1 if c in "âôîûùëïúõåøæœì" else 0.5
        return -2.0 if before.islower() else 0.7 if c in "ÉÀÇÄÖÜÂÊÃÓÁÍÚÕ" else 0.4
    if c in "’'":
        return 1.0 if within else 0.3
    if c in "°º":
        return 1.0 if not within and (before.isdigit() or before.isspace()) else -1.0
    if c == "µ":
        return 1.0 if not before.isalpha() and after.isalpha() else -0.5
    if c in "«“‘„¿¡":
        return 1.0 if not before.isalnum() else -2.0
    if c in "»”":
        return 1.0 if not after.isalnum() else -2.0
    if c in "\xa0–—…·":
        return 0.3 if not within else -0.5
    if c in "±×²³§©®™€£½¼¾ªº•¹÷":
        return 0.5 if not low else -1.0
    return -1.0 if within or "\x80" <= c < "\xa0" else -0.4


#: Parts of a text that were read in one way or another: sentences and lines.
_SENTENCE = re.compile(r"[^\n]*?(?:[.!?;]+(?=\s)|\n|$)")


def _gain(part: str, to: dict[str, str]) -> float:
    """How much better a part gets by a pair of encodings."""
    padded = f" {part} "
    gain = 0.0
    back = "".join(to.get(c, c) for c in padded)
    for i in range(1, len(padded) - 1):
        if padded[i] in to:
            gain += _sound(back[i], back[i - 1], back[i + 1]) - _sound(padded[i], padded[i - 1], padded[i + 1])
    return gain


def _readable(text: str, at: int, pair: str) -> bool:
    """Whether the word around a place has only characters that the reading of the pair has."""
    a = b = at
    while a and text[a - 1].isalpha():
        a -= 1
    while b < len(text) and text[b].isalpha():
        b += 1
    of = _bytes_of(pair.split(">")[1])
    return all(c in of for c in text[a:b])


def _western_pass(text: str) -> tuple[str, int]:
    automaton, order = _western()
    shadow = " " + text.translate(_SHADOW) + " "
    hits: dict[str, set[int]] = {}
    faint: dict[str, set[int]] = {}
    for end, (n, found) in automaton.iter(shadow):
        for at, pair, _, weak in found:
            (faint if weak else hits).setdefault(pair, set()).add(end - n + 1 + at - 1)
    # A word that holds characters which the reading doesn't have wasn't read by it.
    hits = {pair: kept for pair, some in hits.items() if (kept := {i for i in some if _readable(text, i, pair)})}
    # Marks that sound text may hold count where several of them would make letters.
    for pair, some in faint.items():
        if pair in hits or (pair.startswith(("iso8859-2", "cp1250")) and len({text[i] for i in some if text[i] in "±³¹"}) > 1):
            if kept := {i for i in some if _readable(text, i, pair)}:
                hits.setdefault(pair, set()).update(kept)
    for pattern, seen in _symbols():
        for m in pattern.finditer(text):
            for pair in seen[m.group(1)]:
                hits.setdefault(pair, set()).add(m.start(1))
    for pattern, pairs in _quotes():
        for m in pattern.finditer(text):
            for pair in pairs:
                hits.setdefault(pair, set()).add(m.start())
    if not hits:
        return text, 0
    parts = [m for m in _SENTENCE.finditer(text) if not m.group().isascii()]
    most = max(map(len, hits.values()))
    # Pairs share hits, so of those with about as many the one counts by which the text gets best.
    likely = [p for p in hits if 2 * len(hits[p]) >= most]
    gains = {p: [_gain(m.group(), _western_map(p)) for m in parts] for p in likely}
    pair = max(likely, key=lambda p: (sum(g for g in gains[p] if g > 0), len(hits[p]), -order.index(p)))
    # All characters of a part that gets better by the pair are put back; elsewhere those of the words that hold a hit.
    to, chars = _western_map(pair), list(text)
    better = [m.span() for m, g in zip(parts, gains[pair]) if g > 0]
    words, a = [], 0
    for at in sorted(hits[pair]):
        if at < a:
            continue
        a = b = at
        while a and not text[a - 1].isspace():
            a -= 1
        while b < len(text) and not text[b].isspace():
            b += 1
        words.append((a, b))
        a = b
    for a, b in better + words:
        for i in range(a, b):
            if text[i] in to:
                chars[i] = to[text[i]]
    return "".join(chars), len(hits[pair])


def _best_pair(words: list[str], reads: tuple[str, ...], least: float, gain: float, scripts: list = SCRIPTS) -> tuple[dict[str, str], tuple[str, str], dict[str, int]]:
    """What stands for each word in the pair of encodings that makes most of the words good text of its script, ``gain`` better than they are."""
    best, most, pair, told = {}, 0.0, ("", ""), RUSSIAN
    for read in reads:
        for written, letters in scripts:
            if read == written:
                continue
            to, total = {}, 0.0
            for w in words:
                x = _rewritten(w, read, written)
                if x and (score := _russian(x, letters)) >= least and score - _russian(w) >= gain:
                    to[w] = x
                    total += len(w) * (score - (0.3 if x.isupper() else 0))
            if total > most:
                best, most, pair, told = to, total, (read, written), letters
    return best, pair, told


def _short_runs(text: str, to: dict[str, str], read: str, written: str, letters: dict[str, int]) -> str:
    """Rewrite the long runs of ``to``, and by its pair the other runs of the sentences that hold one, or between two rewritten runs."""
    ends = [m.end() for m in _SENTENCE.finditer(text)]
    long = {m.start(): (m.end(), to[m.group()]) for m in _RUN.finditer(text) if m.group() in to}
    held = {bisect_right(ends, a) for a in long}
    # Words beyond ASCII in order: sound ones keep a short run between them from being rewritten.
    words = [m.start() for m in _NOT_ASCII.finditer(text)]
    good = [w in long for w in words]
    for m in _SHORT_RUN.finditer(text):
        if m.start() in long:
            continue
        i = bisect_right(words, m.start()) - 1
        between = any(good[max(0, i - 3) : i]) and any(good[i + 1 : i + 4])
        if bisect_right(ends, m.start()) in held or between:
            x = _rewritten(m.group(), read, written)
            if x and all(c.lower() in letters for c in x):
                long[m.start()] = (m.end(), x)
    out, at = [], 0
    for a, (b, back) in sorted(long.items()):
        out += [text[at:a], back]
        at = b
    return "".join([*out, text[at:]])


def _cyrillic_pass(text: str) -> tuple[str, int]:
    runs = _RUN.findall(text)
    to, pair, letters = _best_pair(runs, ("cp1252", "latin-1"), 2.2, 0)
    n = len(to)
    if to:
        text = _short_runs(text, to, *pair, letters)
    words = list(dict.fromkeys(w for w in _NOT_ASCII.findall(text) if _CYRILLIC_WORD.fullmatch(w)))
    to, pair, _ = _best_pair([w for w in words if len(w) >= 4], CYRILLIC, 2.6, 0.9, SCRIPTS[: len(CYRILLIC)]) if words else ({}, ("", ""), RUSSIAN)
    if sum(map(len, to)) >= 8:  # then shorter and rarer words of that pair count too
        to |= {w: x for w in words if w not in to and (x := _rewritten(w, *pair)) and _russian(x) >= max(2.0, _russian(w) + 0.2)}
        text = _NOT_ASCII.sub(lambda m: to.get(m.group(), m.group()), text)
        n += len(to)
    return text, n


def restore(text: str) -> tuple[bool, str]:
    """(garbled, restored): whether a text holds garbled characters, and the text with those put back that can be."""
    if text.isascii():
        return False, text
    garbled = bool(_CONTROL.search(text))
    seen = {text}
    while True:  # text may have been garbled more than once
        text, a = _japanese_pass(text)
        text, b = _utf8_pass(text)
        garbled = garbled or bool(a or b)
        if text in seen:
            break
        seen.add(text)
    if not text.isascii():
        text, a = _cyrillic_pass(text)
        text, b = _western_pass(text)
        garbled = garbled or bool(a or b)
    return garbled, text


def garbled_texts(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(``doc_id``, ``restored``): each text with characters from decoding with a wrong encoding, put back where possible.

    Garbled sequences of all expected characters are precomputed for the readings of UTF-8 and found by
    one multi-pattern automaton; only matched spans change there, so sound parts stay as they are. Passes repeat
    until nothing is found, as a text may have been garbled several times. Sequences that sound text can also
    hold count only beside another, within a word of another script, or where a sure one of the pair is in the text. Letters
    read in another single-byte encoding are found in contexts in which only a letter can stand, by an automaton
    over a shadow of the text, if the reading has all characters of the word; sentences that get better by the pair are put back whole.
    Cyrillic, Greek, Hebrew and Arabic read as Western text are told by their letter frequencies, from runs of
    three letters on; Cyrillic read as Cyrillic from words of four letters and eight letters together on. Replacement characters and stray control characters can't be put back but are found.

    NULL, empty and plain ASCII texts are never garbled; the latter don't leave the JVM. Whole texts are
    read. Repeated rows each come out. Columns that aren't named aren't read.
    """
    other = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).where(F.octet_length("text") > F.length("text"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out = [], []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                bad, back = restore(t)
                if bad:
                    ids.append(i)
                    out.append(back)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.string())], ["doc_id", "restored"])

    return other.mapInArrow(find, "doc_id bigint, restored string")
