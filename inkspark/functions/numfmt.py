"""Number and date display formats: built-in ids and custom codes.

A code is compiled once per worker (:func:`compile_code`) into sections of parts; a value picks its section by sign, text
goes to the text section, conditions are read but never choose, and a zero counts as positive.  What a code cannot show
(a malformed code, a negative date, an unknown locale in a date) leaves the value as it is.

Numbers: at most 15 digits are rounded, half away from zero on the binary number; longer ones are cut.  Dates follow the
1900 system with its 29 February 1900, or the 1904 system.
"""

from __future__ import annotations

import datetime as dt
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The codes of the built-in ids.  Ids not listed, and 48, show values as they are.
BUILTIN = {
    1: "0", 2: "0.00", 3: "#,##0", 4: "#,##0.00", 9: "0%", 10: "0.00%", 11: "0.00E+00", 12: "# ?/?", 13: "# ??/??",
    14: "mm-dd-yy", 15: "d-mmm-yy", 16: "d-mmm", 17: "mmm-yy", 18: "h:mm AM/PM", 19: "h:mm:ss AM/PM", 20: "hh:mm", 21: "hh:mm:ss", 22: "m/d/yy hh:mm",
    37: "#,##0_);(#,##0)", 38: "#,##0_);[Red](#,##0)", 39: "#,##0.00_);(#,##0.00)", 40: "#,##0.00_);[Red](#,##0.00)",
    41: '_(* #,##0_);_(* (#,##0);_(* "-"_);_(@_)', 42: '_($* #,##0_);_($* (#,##0);_($* "-"_);_(@_)',
    43: '_(* #,##0.00_);_(* (#,##0.00);_(* "-"??_);_(@_)', 44: '_($* #,##0.00_);_($* (#,##0.00);_($* "-"??_);_(@_)',
    45: "mm:ss", 46: "[h]:mm:ss", 47: "mm:ss.0", 49: "@",
}
#: Names of months and weekdays (Sunday first) by language; short months, long months, short days, long days, am and pm.
_EN = (
    "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec", "January February March April May June July August September October November December",
    "Sun Mon Tue Wed Thu Fri Sat", "Sunday Monday Tuesday Wednesday Thursday Friday Saturday", "AM PM",
)
_NUMBERED = " ".join(f"{k}月" for k in range(1, 13))
LANGUAGES = {
    "en": _EN,
    "de": ("Jan Feb Mrz Apr Mai Jun Jul Aug Sep Okt Nov Dez", "Januar Februar März April Mai Juni Juli August September Oktober November Dezember",
           "So Mo Di Mi Do Fr Sa", "Sonntag Montag Dienstag Mittwoch Donnerstag Freitag Samstag", "AM PM"),
    "fr": ("janv. févr. mars avr. mai juin juil. août sept. oct. nov. déc.", "janvier février mars avril mai juin juillet août septembre octobre novembre décembre",
           "dim. lun. mar. mer. jeu. ven. sam.", "dimanche lundi mardi mercredi jeudi vendredi samedi", "AM PM"),
    "es": ("ene. feb. mar. abr. may. jun. jul. ago. sep. oct. nov. dic.", "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre",
           "do. lu. ma. mi. ju. vi. sá.", "domingo lunes martes miércoles jueves viernes sábado", "a.m. p.m."),
    "pt": ("jan fev mar abr mai jun jul ago set out nov dez", "janeiro fevereiro março abril maio junho julho agosto setembro outubro novembro dezembro",
           "dom seg ter qua qui sex sáb", "domingo segunda-feira terça-feira quarta-feira quinta-feira sexta-feira sábado", "AM PM"),
    "ru": ("янв. фев. март апр. май июнь июль авг. сен. окт. ноя. дек.", "январь февраль март апрель май июнь июль август сентябрь октябрь ноябрь декабрь",
           "Вс Пн Вт Ср Чт Пт Сб", "воскресенье понедельник вторник среда четверг пятница суббота", "AM PM"),
    "ja": (_NUMBERED, _NUMBERED, "日 月 火 水 木 金 土", "日曜日 月曜日 火曜日 水曜日 木曜日 金曜日 土曜日", "午前 午後"),
    "zh": (_NUMBERED, "一月 二月 三月 四月 五月 六月 七月 八月 九月 十月 十一月 十二月", "周日 周一 周二 周三 周四 周五 周六", "星期日 星期一 星期二 星期三 星期四 星期五 星期六", "上午 下午"),
    "zh-tw": (_NUMBERED, _NUMBERED, "週日 週一 週二 週三 週四 週五 週六", "星期日 星期一 星期二 星期三 星期四 星期五 星期六", "上午 下午"),
}
#: Language ids.
LCIDS = {0x409: "en", 0x809: "en", 0x407: "de", 0x40C: "fr", 0x40A: "es", 0x416: "pt", 0x816: "pt", 0x419: "ru", 0x411: "ja", 0x804: "zh", 0x404: "zh-tw"}
#: First day, name and letter of the eras since 1912.
ERAS = [(dt.date(2019, 5, 1), "令和", "R"), (dt.date(1989, 1, 8), "平成", "H"), (dt.date(1926, 12, 25), "昭和", "S"), (dt.date(1912, 7, 30), "大正", "T")]

_TOKEN = re.compile(
    r'"(?P<quoted>[^"]*)"|\\(?P<escaped>.)|_(?P<pad>.)|\*(?P<fill>.)|\[\$(?P<locale>[^\]]*)\]|\[(?P<elapsed>[hH]+|[mM]+|[sS]+)\]|\[(?P<other>[^\]]*)\]'
    r"|(?P<ampm>[aA][mM]/[pP][mM]|[aA]/[pP])|(?P<exp>[eE][+-])|(?P<general>[Gg]eneral)|(?P<date>[yY]+|[mM]+|[dD]+|[hH]+|[sS]+|g+|e+)|(?P<digit>0+|#+|\?+)"
    r"|(?P<point>\.)|(?P<comma>,)|(?P<percent>%)|(?P<slash>/)|(?P<text>@)|(?P<semi>;)|(?P<number>[1-9][0-9]*)|(?P<literal>.)", re.S
)


class Unshown(ValueError):
    """The code cannot show the value."""


@dataclass(frozen=True)
class Part:
    kind: str
    text: str


@dataclass(frozen=True)
class Section:
    parts: tuple[Part, ...]
    is_date: bool

    def has(self, kind: str) -> bool:
        return any(p.kind == kind for p in self.parts)


@lru_cache(maxsize=4096)
def compile_code(code: str) -> tuple[Section, ...]:
    """The sections of a code, one to four."""
    sections: list[list[Part]] = [[]]
    for found in _TOKEN.finditer(code):
        kind = found.lastgroup
        text = found[kind]
        if kind == "semi":
            sections.append([])
        elif kind == "escaped":
            sections[-1].append(Part("quoted", text))
        else:
            sections[-1].append(Part(kind, text))
    if len(sections) > 4:
        raise Unshown("more than four sections")
    out = []
    for parts in sections:
        dated = any(p.kind in ("date", "elapsed", "ampm") for p in parts)
        out.append(Section(tuple(parts), dated))
    return tuple(out)


def plain(x: float) -> str:
    """The shortest decimal digits of a number, without an exponent."""
    text = repr(float(x))
    if "e" in text:
        text = format(__import__("decimal").Decimal(text), "f")
    return text.removesuffix(".0")


def significant(x: float, digits: int) -> str:
    """At most so many significant digits, halves of the shortest digits away from zero; an exponent outside of -4 to ``digits``."""
    from decimal import ROUND_HALF_UP, Decimal

    if x == 0:
        return "0"
    value = Decimal(plain(abs(x)))
    exponent = value.adjusted()
    value = value.quantize(Decimal((0, (1,), exponent - digits + 1)), ROUND_HALF_UP)
    exponent = value.adjusted()
    sign = "-" if x < 0 else ""
    if -4 <= exponent < digits:
        text = format(value, "f")
        return sign + (text.rstrip("0").rstrip(".") if "." in text else text)
    body = "".join(map(str, value.as_tuple().digits)).rstrip("0") or "0"
    return f"{sign}{body[0]}{'.' + body[1:] if body[1:] else ''}E{'-' if exponent < 0 else '+'}{abs(exponent):02d}"


def number_of(value: str) -> float | None:
    """The number that a cell's text is, or None."""
    if "_" in value or value != value.strip():
        return None
    try:
        x = float(value)
    except ValueError:
        return None
    return x if math.isfinite(x) else None


def _half_away(x: float) -> float:
    return math.floor(x + 0.5) if x >= 0 else -math.floor(-x + 0.5)


def _grouped(text: str) -> str:
    whole, point, rest = text.partition(".")
    return f"{int(whole):,}".rjust(len(whole), "0") + point + rest if whole else text


def _cut(x: float, decimals: int) -> str:
    whole, _, rest = plain(x).partition(".")
    return whole + ("." + rest[:decimals].ljust(decimals, "0") if decimals else "")


def _fraction(x: float, limit: int) -> tuple[int, int]:
    """The last convergent of ``x`` whose denominator stays below ``limit``."""
    h, k, h0, k0, r, last = 1, 0, 0, 1, x, (0, 0)
    while True:
        a = math.floor(r)
        h, h0, k, k0 = a * h + h0, h, a * k + k0, k
        if k >= limit:
            return last
        last = (h, k)
        if abs(r - a) < 1e-12:
            return last
        r = 1 / (r - a)


def _show_number(section: Section, x: float, raw: str, minus: bool) -> str:
    parts = section.parts
    slash = next((i for i, p in enumerate(parts) if p.kind == "slash"), None)
    counted = [i for i, p in enumerate(parts) if p.kind == "digit" and p.text[0] != "?"]
    last_digit = max(counted, default=-1)
    scale = sum(p.kind == "comma" and i > last_digit for i, p in enumerate(parts)) if counted else 0
    group = any(p.kind == "comma" and i <= last_digit for i, p in enumerate(parts))
    percents = sum(p.kind == "percent" for p in parts)
    point = next((i for i, p in enumerate(parts) if p.kind == "point"), len(parts))
    exponent = next((i for i, p in enumerate(parts) if p.kind == "exp"), None)
    zeros = lambda a, b, c: sum(len(p.text) for p in parts[a:b] if p.kind == "digit" and p.text[0] == c)
    if exponent is not None and zeros(exponent, len(parts), "0") != 2:
        return raw
    end = len(parts) if exponent is None else exponent
    x = x / 1000.0**scale
    size = abs(x)
    digits = plain(size)
    whole_digits, _, fraction_digits = digits.partition(".")
    padding, optional = zeros(point, end, "0"), zeros(point, end, "#")
    decimals = max(padding, min(len(fraction_digits), padding + optional)) if point < len(parts) else 0
    width = max(len(whole_digits), zeros(0, min(point, end), "0"))
    number = number_of(raw)
    long = number is not None and len(plain(abs(number)).replace(".", "").replace("-", "")) > 15
    if exponent is not None:
        text = f"{size * 100.0**percents:.{decimals}E}"
        mantissa, _, power = text.partition("E")
        text = f"{mantissa}E{power[0]}{int(power[1:]):02d}"
    elif width + decimals > 15 and long:
        text = _cut(abs(number) * (100 if percents else 1), decimals)
        text = _grouped(text) if group else text
        text += "%" if percents else ""
    else:
        shown = size * 100.0**percents
        if slash is not None:
            shown = math.floor(shown)
        shown = _half_away(shown * 10.0**decimals) / 10.0**decimals
        text = f"{shown:.{decimals}f}".rjust(width + decimals + bool(decimals), "0")
        text = (_grouped(text) if group else text) + "%" * percents
    # The digits run through the placeholders: the first takes what is over, too few leave the first ones empty.
    stop = len(parts)
    if slash is not None:
        before = [i for i in range(slash) if parts[i].kind == "digit"]
        stop = before[-1] if before else slash
    places = [i for i in range(stop) if parts[i].kind == "digit" and (exponent is None or True)]
    total = sum(len(parts[i].text) for i in places)
    at = min(0, len(text) - total)
    out = ["-"] if minus else []
    first = True
    i = 0
    while i < len(parts):
        p = parts[i]
        if i == stop and slash is not None:
            top = len(p.text) if p.kind == "digit" else 1
            under = next((q for q in parts[slash + 1 :] if q.kind in ("digit", "number")), None)
            part = size - math.floor(size)
            if under is not None and under.kind == "number":
                d = float(under.text)
                out.append(f"{int(_half_away(part * d))}/{int(d)}")
            elif under is not None:
                a, b = _fraction(part, 10 ** len(under.text))
                out.append(" " * (top + len(under.text) + 1) if a == 0 else str(a).rjust(top) + "/" + str(b).ljust(len(under.text)))
            i = parts.index(under, slash) + 1 if under is not None else slash + 1
            continue
        if p.kind == "digit":
            take = len(p.text) + (max(0, len(text) - total) if first else 0)
            first = False
            for k in range(at, at + take):
                out.append(text[k] if 0 <= k < len(text) else " " if p.text[0] == "?" else "")
            at += take
        elif p.kind in ("quoted", "literal", "number"):
            out.append(p.text)
        elif p.kind == "pad":
            out.append(" " if i in (0, len(parts) - 1) else "")
        elif p.kind == "locale":
            out.append(p.text.partition("-")[0])
        i += 1
    return "".join(out)


def _civil(serial: float, date1904: bool) -> tuple[dt.datetime, int]:
    """The moment of a serial in whole seconds, and its microseconds.

    Up to serial 61 of the 1900 system microseconds are kept; from there a remainder above 500 ms makes a second.
    """
    whole = math.floor(serial)
    if not date1904 and whole <= 61:
        day = dt.datetime(1899, 12, 30) + dt.timedelta(days=whole)
        micros = int(86400e9 * (serial - whole) + 500) // 1000
        return day + dt.timedelta(seconds=micros // 1_000_000), micros % 1_000_000
    epoch = dt.datetime(1904, 1, 1) if date1904 else dt.datetime(1899, 12, 30)
    nanos = int(86400e9 * (serial - whole + 1e-9))
    seconds, rest = divmod(nanos, 1_000_000_000)
    if rest // 1_000_000 > 500:
        seconds, rest = seconds + 1, 0
    return epoch + dt.timedelta(days=whole, seconds=seconds), rest // 1000


def language_of(tag: str) -> str | None:
    """The language of a locale tag: the last four hex digits of an id, or a name; None if it is unknown here."""
    if re.fullmatch(r"[0-9A-Fa-f]+", tag):
        return LCIDS.get(int(tag[-4:], 16))
    name = tag.lower()
    return name if name in LANGUAGES else name.partition("-")[0] if name.partition("-")[0] in LANGUAGES else None


def _show_date(section: Section, serial: float, date1904: bool) -> str:
    if serial < 0:
        raise Unshown("a negative date")
    parts = section.parts
    millis = any(p.kind == "point" and k + 1 < len(parts) and parts[k + 1].kind == "digit" for k, p in enumerate(parts))
    moment, micros = _civil(serial, date1904)
    if not millis and micros >= 500_000:
        moment, micros = moment + dt.timedelta(seconds=1), 0
    year, month, day, named = moment.year, moment.month, moment.day, moment.month
    if serial < 2:
        year, month = 1900, 1
    if serial < 1:
        day, named = 0, _civil(serial + 2, date1904)[0].month
    elif serial < 60:
        lag = _civil(serial + 1, date1904)[0]
        day, named = lag.day, lag.month
    elif serial < 61:
        day, month = 29, 2
    lang, tagged = LANGUAGES["en"], ""
    twelve = any(p.kind == "ampm" for p in parts)
    hour = (moment.hour % 12 or 12) if twelve else moment.hour
    elapsed = moment - dt.datetime(1899, 12, 30) + dt.timedelta(microseconds=micros)
    total = elapsed.days * 86400 + elapsed.seconds
    times = [(k, (p.text[0].lower() if p.kind != "ampm" else "p")) for k, p in enumerate(parts) if p.kind in ("date", "elapsed")]
    order = {k: n for n, (k, _) in enumerate(times)}

    def is_minute(k: int) -> bool:
        n = order[k]
        before = times[n - 1][1] if n else ""
        after = times[n + 1][1] if n + 1 < len(times) else ""
        if before == "m" and n >= 2 and parts[times[n - 1][0]].kind == "elapsed":
            before = "h"
        return before in ("h", "s") or after == "s" or bool(n) and parts[times[n - 1][0]].kind == "elapsed"

    out: list[str] = []
    k = 0
    while k < len(parts):
        p = parts[k]
        c, w = p.text[:1].lower(), len(p.text)
        if p.kind == "locale":
            money, _, tag = p.text.partition("-")
            if money:
                out.append(money)
            elif tag:
                name = language_of(tag)
                if name is None:
                    raise Unshown("an unknown locale")
                lang, tagged = LANGUAGES[name], name
        elif p.kind == "elapsed":
            out.append(str({"h": total // 3600, "m": total // 60, "s": total}[c]))
        elif p.kind == "ampm":
            pm = moment.hour >= 12
            if tagged and tagged in ("ja", "zh", "zh-tw"):
                out.append(lang[4].split()[pm])
            else:
                word = "PM" if pm else "AM"
                word = word if p.text == p.text.upper() else word.lower()
                out.append(word)
        elif p.kind == "date" and c == "y":
            out.append(f"{year % 100:02d}" if w <= 2 else str(year))
        elif p.kind == "date" and c == "m" and is_minute(k):
            out.append(str(moment.minute) if w == 1 else f"{moment.minute:02d}")
        elif p.kind == "date" and c == "m":
            short, long = lang[0].split()[named - 1], lang[1].split()[named - 1]
            out.append(str(month) if w == 1 else f"{month:02d}" if w == 2 else short if w == 3 else long[0] if w == 5 and tagged else short[0] if w == 5 else long)
        elif p.kind == "date" and c == "d":
            weekday = (moment.weekday() + 1) % 7
            out.append(str(day) if w == 1 else f"{day:02d}" if w == 2 else lang[2].split()[weekday] if w == 3 else lang[3].split()[weekday])
        elif p.kind == "date" and c == "h":
            out.append(str(hour) if w == 1 else f"{hour:02d}")
        elif p.kind == "date" and c == "s":
            out.append(str(moment.second) if w == 1 else f"{moment.second:02d}")
        elif p.kind == "date" and c in "ge":
            out.append(_era(moment.date(), tagged, c, w))
        elif p.kind == "point":
            if k + 1 < len(parts) and parts[k + 1].kind == "digit":
                out.append("." + f"{micros // 1000:03d}"[: min(3, len(parts[k + 1].text))])
                k += 1
            else:
                out.append(".")
        elif p.kind == "pad":
            out.append(" " if k in (0, len(parts) - 1) else "")
        elif p.kind in ("quoted", "literal", "slash", "comma", "number"):
            out.append(p.text)
        k += 1
    return "".join(out)


def _era(day: dt.date, language: str, letter: str, width: int) -> str:
    if language == "ja":
        for first, name, short in ERAS:
            if day >= first:
                years = day.year - first.year + 1
                return {1: short, 2: name[0]}.get(width, name) if letter == "g" else str(years) if width == 1 else f"{years:02d}"
        return ""
    if language == "zh-tw":
        if letter == "g":
            return "中華民國" if width > 2 else "民國"
        return str(day.year - 1912 + 1) if width == 1 else ""
    return str(day.year) if letter == "e" else ""


def display(value: str, code: str, kind: str = "number", date1904: bool = False) -> str:
    """What a cell of the given kind shows under a code."""
    number = number_of(value) if kind in ("number", "date", "unset") else None
    try:
        sections = compile_code(code)
        if number is None:
            return _show_text(sections, value)
        section, minus, x = sections[0], False, number
        if number < 0:
            if len(sections) > 1:
                section, x = sections[1], -number
                if section.is_date:
                    return value
            else:
                minus = True
        if not section.parts:
            return ""
        if section.is_date:
            return _show_date(section, number, date1904)
        if section.has("general"):
            digits = plain(abs(number)).replace(".", "")
            return significant(number, 10) if len(digits.lstrip("0")) > 11 else value
        if section.has("text"):
            return "".join(value if p.kind == "text" else "" for p in section.parts if p.kind == "text")
        return _show_number(section, abs(x), value, minus)
    except Unshown:
        return value


def _show_text(sections: tuple[Section, ...], value: str) -> str:
    if len(sections) < 4 and not any(p.kind == "text" for p in sections[-1].parts):
        return value
    section = sections[-1]
    return "".join(value if p.kind == "text" else p.text if p.kind in ("quoted", "literal") else " " if p.kind == "pad" else "" for p in section.parts)


def display_id(value: str, fmt: int, codes: dict[int, str] | None = None, kind: str = "number", date1904: bool = False) -> str:
    """What a cell shows under a format id: a custom code, a built-in one, or none."""
    code = (codes or {}).get(fmt) or BUILTIN.get(fmt)
    if code is None or code == "@":
        return value
    return display(value, code, kind, date1904)


def iso_to_serial(text: str) -> float | None:
    """The 1900-system serial of an ISO date: ``2023-01-01T10:00:00Z``, ``2023-01-01 10:00:00`` or ``20230101T100000``."""
    found = re.fullmatch(r"([0-9]+)-([0-9]+)-([0-9]+)(?:T([0-9]+):([0-9]+):([0-9]+)Z| ([0-9]+):([0-9]+):([0-9]+))", text) or re.fullmatch(
        r"([0-9]{4})([0-9]{2})([0-9]{2})T([0-9]{2})([0-9]{2})([0-9]{2})[0-9]*Z?", text
    )
    if not found:
        return None
    numbers = [int(g) for g in found.groups() if g is not None]
    try:
        moment = dt.datetime(*numbers[:6])
    except ValueError:
        return None
    days = (moment.date() - dt.date(1899, 12, 31)).days + (moment.date() > dt.date(1900, 2, 28))
    return days + (moment.hour * 3600 + moment.minute * 60 + moment.second) / 86400


def display_column(value: Column, code: Column) -> Column:
    """:func:`display` over columns, in Arrow batches; codes are compiled once per worker."""
    from ..session import ship
    from pyspark.sql import SparkSession

    ship(SparkSession.active())

    @F.pandas_udf("string")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for values, codes in batches:
            yield pd.Series([None if v is None or c is None else display(v, c) for v, c in zip(values, codes, strict=True)])

    return run(value, code)


def scientific(x: Column, digits: int = 2) -> Column:
    """A signed exponent of two digits at least; ties are those of the binary number, which SQL's decimal printing hides."""

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if pd.isna(v) else f"{v:.{digits}E}")

    return run(x)
