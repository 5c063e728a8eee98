"""Oracle date format models expressed as Spark datetime patterns."""

from __future__ import annotations

import re
from dataclasses import dataclass

# Oracle format elements and the datetime pattern letters with the same meaning.
ELEMENTS = {
    "YYYY": "yyyy",
    "RRRR": "yyyy",
    "YY": "yy",
    "RR": "yy",
    "MONTH": "MMMM",
    "MON": "MMM",
    "MM": "MM",
    "DDD": "DDD",
    "DD": "dd",
    "DAY": "EEEE",
    "DY": "EEE",
    "HH24": "HH",
    "HH12": "hh",
    "HH": "hh",
    "MI": "mm",
    "SS": "ss",
    "AM": "a",
    "PM": "a",
    "Q": "q",
}
# Elements of two digits that may be written with one.
SHORT = ("MM", "DD", "HH24", "HH12", "HH", "MI", "SS")
NAMES = ("MONTH", "MON", "DAY", "DY", "AM", "PM")

_TOKEN = re.compile(
    r'"(?P<quoted>[^"]*)"|(?P<fill>FM)|FF(?P<frac>[1-9]?)|(?P<elem>'
    + "|".join(sorted(ELEMENTS, key=len, reverse=True))
    + r")|(?P<other>.)",
    re.IGNORECASE | re.DOTALL,
)


# Names that are filled up with blanks to the longest one.
FILLED = {"MONTH": 9, "DAY": 9}


def format_pieces(model: str) -> list[tuple[str, str, int]]:
    """Split a format model into (spark pattern, letter case, width) pieces.

    The letter case is 'upper', 'lower' or '' and applies to name elements: MON gives JAN, Mon gives
    Jan, mon gives jan.  MONTH and DAY are filled with blanks to their width.  FM turns filling off, that of names as well as leading zeros, and on again.
    Neighbouring pieces of the same case without a width are merged.
    """
    pieces: list[tuple[str, str, int]] = []
    fill = True
    for token in _TOKEN.finditer(model):
        case, width = "", 0
        if token["fill"]:
            fill = not fill
            continue
        if token["quoted"] is not None:
            pattern = "'" + token["quoted"].replace("'", "''") + "'"
        elif token["elem"]:
            word = token["elem"]
            pattern = ELEMENTS[word.upper()]
            if word.upper() in SHORT and not fill:
                pattern = pattern[0]
            if word.upper() in NAMES:
                case = "upper" if word.isupper() else "lower" if word.islower() else ""
                width = FILLED.get(word.upper(), 0) if fill else 0
        elif token["other"] is not None:
            ch = token["other"]
            if ch.isalpha():
                raise ValueError(f"unsupported element in date format model {model!r}: {ch!r}")
            pattern = "''" if ch == "'" else ch
        else:
            pattern = "S" * int(token["frac"] or 6)
        if pieces and pieces[-1][1:] == (case, 0) and not width:
            pieces[-1] = (pieces[-1][0] + pattern, case, 0)
        else:
            pieces.append((pattern, case, width))
    return pieces


def spark_pattern(model: str) -> str:
    """The whole model as one pattern for parsing: letter case doesn't count, and numbers between separators may have one digit."""
    tokens = [t for t in _TOKEN.finditer(model) if not t["fill"]]
    out = []
    for i, token in enumerate(tokens):
        word = (token["elem"] or "").upper()
        beside = tokens[max(i - 1, 0):i] + tokens[i + 1:i + 2]
        if word in SHORT and all(t["other"] is not None or t["quoted"] is not None for t in beside):
            out.append(ELEMENTS[word][0])
        else:
            out.append("".join(piece[0] for piece in format_pieces(token[0])))
    return "".join(out)


def has_element(model: str, element: str) -> bool:
    return any((token["elem"] or "").upper() == element for token in _TOKEN.finditer(model))


def has_names(model: str) -> bool:
    return any(token["elem"] and token["elem"].upper() in NAMES for token in _TOKEN.finditer(model))


@dataclass(frozen=True)
class NumberModel:
    """A number format model taken apart: the digits before and after the point, and what stands around them."""

    whole: str  # 9, 0 and , as written
    places: str  # 9 and 0 after the point
    point: bool
    sign: str  # "", "S first", "S last", "MI" or "PR"
    currency: str  # "", "$" or "L"
    fill: bool

    @property
    def digits(self) -> int:
        return sum(c != "," for c in self.whole)

    @property
    def forced(self) -> int:
        """Digits before the point that are shown even if they are leading zeros."""
        plain = self.whole.replace(",", "")
        return len(plain) - plain.index("0") if "0" in plain else 0

    @property
    def width(self) -> int:
        around = {"": 1, "S first": 1, "S last": 1, "MI": 1, "PR": 2}[self.sign]
        return len(self.whole) + self.point + len(self.places) + around + {"": 0, "$": 1, "L": 10}[self.currency]


_NUMBER = re.compile(r"(?P<fill>FM)?(?P<first>S)?(?P<cur>[L$])?(?P<whole>[90,G]*)(?:(?P<point>[.D])(?P<places>[90]*))?(?P<cur2>[L$])?(?P<last>S|MI|PR)?", re.IGNORECASE)


def number_model(model: str) -> NumberModel:
    """9 0 , G . D S MI PR $ L and FM; anything else, or a model without digits, is an error."""
    found = _NUMBER.fullmatch(model)
    whole = (found["whole"] or "").upper().replace("G", ",") if found else ""
    places = (found["places"] or "") if found else ""
    if not found or not (whole.strip(",") or places) or whole.startswith(",") or (found["first"] and found["last"]) or (found["cur"] and found["cur2"]):
        raise ValueError(f"unsupported number format model {model!r}")
    sign = "S first" if found["first"] else {"S": "S last", "MI": "MI", "PR": "PR"}.get((found["last"] or "").upper(), "")
    return NumberModel(whole, places, found["point"] is not None, sign, (found["cur"] or found["cur2"] or "").upper(), found["fill"] is None)


def is_number_model(model: str) -> bool:
    found = _NUMBER.fullmatch(model)
    return bool(found and (found["whole"] or found["places"]))
