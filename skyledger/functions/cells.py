"""Cells of a schedule table as columns: normal forms for comparison, repairs of what was misread, dates inside texts.

Everything is a JVM-side expression. ``rewritten`` stands in for a callback over matches: the matches are
marked, split off and given to an expression each.

Defined results: null counts as an empty cell; an empty cell stays empty; what no rule reads stays as it is.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names as they are printed, weekdays from Sunday on.
MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]
WEEKDAYS = ["SUN", "MON", "TUE", "WED", "THU", "FRI", "SAT"]
#: The fields that every kind of roster has.
CORE_FIELDS = ["date", "day", "duty", "dep", "begin", "end", "arr"]
#: Three letters that name a duty and never an airport.
NOT_AIRPORTS = ["OFF", "SBY", "RST", "IDP", "TRG", "SIM", "DHY", "CAB"]
#: Printed names for the kinds of misreadings.
EMPTY, PATTERN, FORMAT, VALUE, NO_LABEL, NO_READING = "empty_extraction", "pattern_mismatch", "format_mismatch", "value_mismatch", "missing_expected", "missing_extracted"

_MARK = "\u0001"
_MONTH = "|".join(MONTHS)
_DAY = "Mon|Tue|Wed|Thu|Fri|Sat|Sun"


def rewritten(text: Column, pattern: str, f: Callable[[Column], Column]) -> Column:
    """The text with each match of pattern replaced by f(match)."""
    parts = F.split(F.regexp_replace(text, pattern, f"{_MARK}$0{_MARK}"), _MARK)
    return F.when(text.rlike(pattern), F.array_join(F.transform(parts, lambda p, i: F.when(i % 2 == 1, f(p)).otherwise(p)), "")).otherwise(text)


def chained(text: Column, *steps: tuple[str, str]) -> Column:
    for pattern, to in steps:
        text = F.regexp_replace(text, pattern, to)
    return text


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value worked out once."""
    return F.get(F.transform(F.array(value), body), 0)


def first_of(items: Column) -> Column:
    return F.get(items, 0)


def text_of(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit(""))


def squeezed(value: Column) -> Column:
    """Without blanks at the ends, one blank for each run inside."""
    return F.trim(F.regexp_replace(text_of(value), r"[\s ]+", " "))


def capped(value: Column, length: int) -> Column:
    """A cell as it is stored: trimmed and cut at the field's length."""
    return F.substring(F.trim(text_of(value)), 1, length)


def projected(columns: list[str], fields: list[str], length: int = 500) -> list[Column]:
    """Exactly ``fields``, in order, as stored cells; fields that the table lacks are empty, other columns go."""
    return [(capped(F.col(f), length) if f in columns else F.lit("")).alias(f) for f in fields]


def folded_text(value: Column) -> Column:
    """Lower case without accents: letters of Latin scripts are decomposed, their marks dropped."""
    plain, marked = _accents()
    return F.translate(F.lower(text_of(value)), marked, plain)


def _accents() -> tuple[str, str]:
    import unicodedata

    pairs = [(unicodedata.normalize("NFD", c)[0], c) for c in map(chr, range(0xC0, 0x250)) if len(unicodedata.normalize("NFD", c)) > 1 and c.lower() == c]
    marks = "".join(chr(c) for c in range(0x300, 0x370))
    return "".join(p for p, _ in pairs), "".join(c for _, c in pairs) + marks


# ---- normal forms -----------------------------------------------------------------------


def normal_cell(field: str, value: Column) -> Column:
    """How a cell is compared: weekdays by three capitals, times as ``HH:MM Z``, month names by three letters."""
    raw = squeezed(value)
    if field == "day":
        return F.upper(F.substring(raw, 1, 3))
    if field in ("dep", "arr"):
        return F.upper(raw)
    if field == "duty":
        return chained(F.upper(raw), (r"^0FF\b", "OFF"), (r"\bOFF\s*\(\s*[0O2Z]\s*\)", "OFF(Z)"), (r"\bA/L\s*\.\s*\(", "A/L("))
    if field in ("begin", "end"):
        pattern = r"(\d{1,2})[:.]?(\d{2})\s*(Z)?"
        hour = F.lpad(F.regexp_extract(F.upper(raw), pattern, 1), 2, "0")
        return F.when(raw.rlike(pattern), F.concat(hour, F.lit(":"), F.regexp_extract(F.upper(raw), pattern, 2), F.lit(" Z"))).otherwise(F.upper(raw))
    if field == "date":
        words = F.regexp_extract_all(raw, F.lit(r"\w+|\W+"), F.lit(0))
        return F.array_join(F.transform(words, lambda w: F.when(w.rlike("^[A-Za-z]{3,}$"), F.initcap(F.substring(w, 1, 3))).otherwise(w)), "")
    return raw


def duty_code(value: Column) -> Column:
    """A duty in capitals, its brackets and the blank after a carrier's letters restored."""
    return F.trim(chained(
        F.upper(squeezed(value)), (r"^0FF\b", "OFF"), (r"\bOFF\s*\(\s*[0O2Z]\s*\)", "OFF(Z)"), (r"\bA/L\s*\.\s*\(\s*([A-Z0-9])\s*\)", "A/L($1)"),
        (r"\bA/L\s*\(\s*([ZT])\s*\)", "A/L($1)"), (r"\bFR(\d{2,5})\b", "FR $1"), (r"\bSBYD(\d{3,4})\b", "SBY0$1"),
    ))


def is_duty_noise(value: Column) -> Column:
    """Whether a text in the duty column is none: check-in words, several numbers, sentences."""
    t = duty_code(value)
    #: fixed values
    known = r"^(OFF|SBY|RST|SIM|TRG|A/L|F/D|FR\s|DH\d)"
    noise = [
        r"\bCHECK[- ]?(IN|OUT)\b", r"\bREST OF THIS ROSTER IS PLANNED\b", r"\d{2,}\s+\d{2,}", r"\bFR\s+\d{3,}\s+FR\s+\d{3,}\b", r"^\d{1,2}\s+OFF\b", r"^OFF\s+\d{1,2}\b",
        r"^[A-Z]{2,}\d{4,}\s+[A-Z]{2,}\d{4,}\b",
    ]
    return (t == "") | t.rlike("|".join(noise)) | (t.rlike(r"^\w+\s+\w+\s+\w+\s+\w+") & ~t.rlike(known))


def is_airport_code(value: Column) -> Column:
    """Three capitals that name neither a weekday, a month nor a duty; a slash, bracket, colon or two digits speak against it."""
    raw = F.trim(text_of(value))
    letters = F.upper(F.regexp_replace(raw, "[^A-Za-z]", ""))
    taken = [*WEEKDAYS, *(m.upper() for m in MONTHS), *NOT_AIRPORTS]
    return ~raw.rlike(r"[/():]|\d.*\d") & letters.rlike("^[A-Z]{3}$") & (raw == F.upper(raw)) & ~letters.isin(taken)


def is_flight_duty(value: Column) -> Column:
    """A duty cell that may be a flight's: blank, or with a digit."""
    return (F.trim(text_of(value)) == "") | text_of(value).rlike(r"\d")


#: Duties that open and close a duty period (one letter may be misread), and hotels.
CHECK_IN, CHECK_OUT, HOTEL = r"(?i)^(C/I|CH[A-Z]CK[- ]?IN)$", r"(?i)^(C/O|CH[A-Z]CK[- ]?OUT)$", r"(?i)^(HT|HTL|H\d+\*?|H\?)$"
#: Fixed value: a flight number, with or without its carrier's letters.
FLIGHT_DUTY = r"^(?:FR|DH)? ?\d{2,4}$"


def error_kind(field: str, read: Column, label: Column) -> Column:
    """Why a read cell differs from its label, by the field's form; null where they are equal. Both in normal form."""
    p, e = text_of(read), text_of(label)
    by_form = F.lit(VALUE)
    if field == "duty":
        #: fixed values
        form = r"^(OFF|SBY|RST|FR|DH|A/L|F/D|SIM|TRG|C\d|IDP)"
        by_form = F.when(~p.rlike(form) & (F.length(e) > 2), PATTERN).otherwise(VALUE)
    elif field in ("begin", "end"):
        by_form = F.when(~p.rlike(r"^\d{2}:\d{2}\s+Z$"), FORMAT).otherwise(VALUE)
    elif field in ("dep", "arr"):
        by_form = F.when(F.length(p) != 3, FORMAT).otherwise(VALUE)
    return F.when(p == e, None).when(e == "", NO_LABEL).when(p == "", NO_READING).otherwise(by_form)


# ---- times ------------------------------------------------------------------------------

_BEFORE, _ZULU = r"(?<![A-Za-z0-9])", r"(?=\s*[Zz](?![a-z]))"


def canonical_times(text: Column) -> Column:
    """Every time that can be told as ``HH:MM Z``; flight numbers, dates and standby codes are left alone."""

    def bracket(p: Column) -> Column:
        half = lambda i: F.regexp_replace(F.regexp_replace(F.regexp_extract(p, r"^\(?([0-9()]{1,3}):([0-9()]{1,3})$", i), r"\)", ""), r"\(", "0")
        whole = [F.when(F.length(half(i)) < 2, F.rpad(half(i), 2, "0")).otherwise(half(i)) for i in (1, 2)]
        fits = p.rlike(r"[()]") & (F.length(whole[0]) == 2) & (F.length(whole[1]) == 2)
        return F.when(fits, F.concat(whole[0], F.lit(":"), whole[1])).otherwise(p)

    def letters(p: Column) -> Column:
        return F.when(p.rlike("[OSIl]") & p.rlike(r"\d.?:") & p.rlike(r":.?\d"), F.translate(p, "OSIl", "0511")).otherwise(p)

    def clock(p: Column) -> Column:
        hour, minute = (F.regexp_extract(p, r"^(\d{1,2})[:. ]?(\d{2})", i) for i in (1, 2))
        return F.when((hour.try_cast("int") <= 23) & (minute.try_cast("int") <= 59), F.concat(F.lpad(hour, 2, "0"), F.lit(":"), minute, F.lit(" Z"))).otherwise(p)

    t = rewritten(text_of(text), _BEFORE + r"\(?([0-9()]{1,3}):([0-9()]{1,3})" + _ZULU, bracket)
    t = rewritten(t, _BEFORE + r"([0-9OSIl]{2}):([0-9OSIl]{2})" + _ZULU, letters)
    t = chained(
        t, (_BEFORE + r"Z([0-3]):([0-5]\d)" + _ZULU, "2$1:$2"), (r"(?<![A-Za-z0-9:.\-])([01]\d|2[0-3])1([0-5]\d)" + _ZULU, "$1:$2"),
        (_BEFORE + r"(\d{4})2(\d{4})(?=\s*[Zz])", "$1 Z $2"), (r"([Zz])(?=\d)", "$1 "),
    )
    t = rewritten(t, r"(?<![A-Za-z0-9:.\-])(?:\d{2}:\d{2}|\d{1,2}[ .]?\d{2}" + _ZULU + r")(?:\s*[Zz](?![a-z]))?", clock)
    return F.regexp_replace(t, r"(\d{2}:\d{2} Z)(?=[A-Z])", "$1 ")


def row_text(text: Column) -> Column:
    """A table row's text with its zone marks set apart, days off spelt out and canonical_times()."""
    t = chained(text_of(text), (r"(\d{2}:\d{2})\s*([Zz2])\b", "$1 $2"), (r"\b([Zz])\s*(\d{2}:\d{2})", "$1 $2"))
    t = rewritten(t, r"(\d{2}:\d{2})\s*\d*(\d{2}:\d{2})", lambda p: F.when(F.left(p, F.lit(5)) != F.right(p, F.lit(5)), F.concat(F.left(p, F.lit(5)), F.lit(" Z "), F.right(p, F.lit(5)))).otherwise(p))
    t = chained(
        t, (r"(?i)(\d{2}:\d{2})\s*[2z]\s*(\d{2}:\d{2})", "$1 Z $2"), (r"(\d{2}:\d{2})\s+2(?=\s+[A-Z]|$)", "$1 Z"), (r"(?<=^|\s)2\s+(\d{2}:\d{2})", "Z $1"),
        (r"(?i)OFF\((\d)\)", "OFF(Z)"), (r"(?i)0FF", "OFF"),
    )
    return canonical_times(t)


def times_in(text: Column) -> Column:
    """array<string> of the times in a text, ``HH:MM Z``."""
    found = F.regexp_extract_all(text_of(text), F.lit(r"(\d{2}:\d{2})(?:\s*[Zz])?"), F.lit(1))
    valid = F.filter(found, lambda t: (F.substring(t, 1, 2).try_cast("int") <= 23) & (F.substring(t, 4, 2).try_cast("int") <= 59))
    return F.transform(valid, lambda t: F.concat(t, F.lit(" Z")))


# ---- names, dates -----------------------------------------------------------------------


def _nearest(value: Column, names: list[str]) -> Column:
    """The first name that the first three letters are, else the first that is one edit away."""
    t, every = F.lower(F.substring(text_of(value), 1, 3)), F.array(*map(F.lit, names))
    same, near = F.filter(every, lambda n: F.lower(n) == t), F.filter(every, lambda n: F.levenshtein(F.lower(n), t) <= 1)
    return F.when(t == "", None).otherwise(F.coalesce(first_of(same), first_of(near)))


def fuzzy_month(value: Column) -> Column:
    return _nearest(value, MONTHS)


def fuzzy_weekday(value: Column) -> Column:
    return _nearest(value, WEEKDAYS)


def day_number(date: Column) -> Column:
    """Days since 1970 of ``7 Jan 25``, a day that the month lacks running over; null if it is none."""
    pattern = rf"(?i)(\d{{1,2}}) ({_MONTH}) (\d{{2}})"
    month = F.array_position(F.array(*[F.lit(m.lower()) for m in MONTHS]), F.lower(F.regexp_extract(date, pattern, 2)))
    year = F.regexp_extract(date, pattern, 3).try_cast("int") + 2000
    return F.when(date.rlike(pattern), F.unix_date(F.make_date(year, month.cast("int"), F.lit(1))) + F.regexp_extract(date, pattern, 1).try_cast("int") - 1)


def printed_day(number: Column) -> Column:
    return F.date_format(F.date_from_unix_date(number.cast("int")), "d MMM yy")


def weekday_name(number: Column) -> Column:
    return F.upper(F.date_format(F.date_from_unix_date(number.cast("int")), "EEE"))


def date_in_text(text: Column) -> Column:
    """struct<date, day, matched>: the first printed date of a text as ``7 Jan 25``, its weekday (printed, else worked out)
    and the part that it was read from; null where there is none."""
    part = lambda year: rf"\b(?:({_DAY})[A-Za-z]*[.,\s]*)?(\d{{1,2}})\s*[-./]?\s*({_MONTH})[A-Za-z.]*\s*[-./]?\s*{year}"
    short, long = "(?i)" + part(r"(\d[A-Za-z0-9])(?!\d)") + "(?-i:(?![a-z]))", "(?i)" + part(r"\d{2}(\d{2})(?![a-z0-9])")
    t = text_of(text)

    def read(pattern: str) -> Column:
        at = lambda i: F.regexp_extract(t, pattern, i)
        year = F.regexp_replace(F.regexp_replace(at(4), "[Oo]", "0"), r"\D", "")
        number = at(2).try_cast("int")
        date = F.concat_ws(" ", number.cast("string"), fuzzy_month(at(3)), year)
        day = F.coalesce(F.when(at(1) != "", fuzzy_weekday(at(1))), weekday_name(day_number(date)))
        return F.when((F.length(year) == 2) & number.between(1, 31), F.struct(date.alias("date"), day.alias("day"), at(0).alias("matched")))

    return F.when(t.rlike(short), read(short)).when(t.rlike(long), read(long))


# ---- duties -----------------------------------------------------------------------------

#: Every form of duty that labels have.
DUTY_SHAPE = (
    r"^(?:OFF ?\(Z\)|OFF|OFFZ|OFF/A|OFF\(A\)|C\d{2}|A/L ?\([ZT]\)|SBY[\dD]\d{3}-Z|(?:FR|DH) ?\d{2,4}|\d{2,4}|\d{4} \d{4}|CHECK-IN|CHECK-OUT|CTOT?|I?T?SIM|\dTO(?: SIM)?|GT|G?\dTRG|GTRG|F/D|SFTY|RST\d|HSBY|AL/?MAL|ALM|N/A"
    r"|[IT]?LCK(?: \d{3,4})?|ITUD|U/L|ERST|INTSP|\dD OFF\(Z\)|DH FR\d{2,4}|RST \d (?:OPC|LPC|TRNG)|Unallocated|N?TSP|RETR)$"
)
#: What is left of a month's name, and of a date cell, in front of a duty.
_MONTH_LEFT = "(?:JAN|JN|FEB|F6B|FB|MAR|MR|APR|AP|MAY|MAV|MY|JUN|JU1|JUI|JUL|AUG|AU|AG|SEP|OCT|QCT|0CT|OC|NOV|DEC)"
_DATE_LEFT = rf"(?i)^(?:\d{{1,2}}[()]{{0,2}}|[()]{{1,2}}|\d{{0,2}}{_MONTH_LEFT}\d{{0,2}}|Z\d?|\d?Z|(?!FR|DH)[A-Z]{{1,2}}\d{{0,4}}|\d[A-Z]{{1,2}}\d{{0,2}})$"
_GLUED = rf"(?i)^(?:\d{{0,2}}{_MONTH_LEFT}?\d{{0,2}}|Z\d?)(OFF\(Z\)|OFF|A/L\([ZT]\)|C\d{{2}}|CHECK-IN|CHECK-OUT|CTO|HSBY|SIM|SFTY|ALMAL|ITUD|\dTRG)$"
#: Codes with one letter misread.
_SLIPS = [
    (r"(?i)^[QO0][EF]F(?=\(|$)", "OFF"), (r"(?i)^O?[EF]F\s*(?:\(?Z\)|\(Z\)?|\))$", "OFF(Z)"), (r"(?i)^O[BEF5][F5]\(Z\)$", "OFF(Z)"), (r"(?i)^OFF\(Z$", "OFF(Z)"), (r"(?i)^A/?L\s*\(?([ZT])[Z)]*$", "A/L($1)"),
    (r"(?i)^[CQ]HE?C?K-?\s*(?:[QO0]?[U0]?T|O[0O]T|00[7T])$", "CHECK-OUT"), (r"(?i)^CH[FE]CK-OUT$", "CHECK-OUT"), (r"(?i)^CHECK-?[TI1]N$", "CHECK-IN"), (r"(?i)^CT[Q0]$", "CTO"), (r"(?i)^S[8B]Y(?=\d)", "SBY"),
    (r"(?i)^STM$", "SIM"), (r"C[Il|]9$", "C19"),
]


def bracketed_duty(value: Column) -> Column:
    """A duty with the brackets of days off and leave restored, and letters that no code has put right."""
    t = chained(
        text_of(value), (r"(?i)0FF", "OFF"), (r"\bC[Il|]9\b", "C19"), (r"\bRS7(\d)\b", "RST$1"), (r"(^|[^F])OF\(([ZA])\)", "$1OFF($2)"), (r"\s+", " "), (r"^[\s,|;:.\-]+|[\s,|;:.\-]+$", "")
    )
    code, zone = (F.upper(F.regexp_extract(t, r"(?i)^(OFF|A/L)\s*\(?\s*([ZAT])\s*\)?$", i)) for i in (1, 2))
    as_is = (code == "") | ((code == "OFF") & (zone == "T")) | ((code == "OFF") & (zone == "A") & ~t.rlike("[()]"))
    return F.when(as_is, t).otherwise(F.concat(code, F.lit("("), zone, F.lit(")")))


def _one_duty(token: Column) -> Column:
    """A duty's last word, slips put right and debris of the date in front of it dropped."""

    def debris(s: Column) -> Column:
        head = F.regexp_extract(s, r"(?i)^(\d{1,2}|Z\d?)(?=[A-Z])", 1)
        tail = F.concat(head, chained(F.substr(s, F.length(head) + 1), *_SLIPS))
        return F.when((head != "") & ~s.rlike(_GLUED) & tail.rlike(_GLUED), tail).otherwise(s)

    def code(s: Column) -> Column:
        found = F.regexp_extract(s, _GLUED, 1)
        s = F.when((found != "") & (F.length(found) < F.length(s)), F.upper(found)).otherwise(s)
        return chained(s, (r"^2\d(\d{4})$", "$1"), (r"(?i)^SBY(\d{4}) ?-? ?Z$", "SBY$1-Z"))

    return let(let(chained(token, *_SLIPS), debris), code)


def cleaned_duty(value: Column) -> Column:
    """A duty without debris of its date cell: the fewest leading words of debris go that leave a known form."""
    d = chained(F.trim(text_of(value)), (r"(?i)^DH\s*FR\s*(\d{2,4})$", "DH FR$1"), (r"(?i)^RST\s*(\d)\s*(OPC|LPC|TRNG)$", "RST $1 $2"))
    #: fixed value
    word = F.lit("UNALLOCATED")
    d = F.when(d.rlike("(?i)^U[A-Z1]{3,10}$") & ((F.levenshtein(F.upper(d), word) <= 4) | d.rlike("(?i)LLOC|LLOA|NLOA")), "Unallocated").otherwise(d)

    def of_words(words: Column) -> Column:
        n = F.size(words)
        fixed = F.concat(F.slice(words, 1, n - 1), F.array(_one_duty(F.element_at(words, -1))))

        def rest(tokens: Column) -> Column:
            left = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda k: F.struct(k.alias("k"), F.array_join(F.slice(tokens, k + 1, n), " ").alias("t")))
            junk = lambda k: F.forall(F.slice(tokens, 1, k), lambda w: w.rlike(_DATE_LEFT))
            fits = F.filter(left, lambda x: (x["k"] > 0) & junk(x["k"]) & _one_duty(x["t"]).rlike(DUTY_SHAPE))
            return _one_duty(F.coalesce(first_of(fits)["t"], F.array_join(tokens, " ")))

        return let(fixed, rest)

    return F.when(d == "", d).otherwise(let(F.split(d, " "), of_words))


def spaced_flights(duty: Column, blank: Column) -> Column:
    """Flight numbers of a duty with the blank after the carrier's letters, or without."""
    return F.when(blank, F.regexp_replace(duty, r"\bFR ?(\d{2,5}[A-Z]?)\b", "FR $1")).otherwise(F.regexp_replace(duty, r"\bFR ?(\d{2,5}[A-Z]?)\b", "FR$1"))


# ---- small readers ----------------------------------------------------------------------


def tidy_tags(value: Column) -> Column:
    """``[ FT 05:49 ][DT 09:50]`` as ``[FT 05:49] [DT 09:50]``."""
    return F.trim(chained(text_of(value), (r"\[\s+", "["), (r"\s+\]", "]"), (r"([\])])(?=[\[(])", "$1 "), (r"\s+", " ")))


def unglued(text: Column) -> Column:
    """Words that were read without the blank between them: a time's zone, a month beside digits, a number before a code."""
    return chained(
        text_of(text), (r"(\d{1,2}[:.]\d{1,2}\s?Z)(?=[A-Z0-9(])", "$1 "), (rf"(\d)({_MONTH})", "$1 $2"), (rf"({_MONTH})(\d)", "$1 $2"), (r"(^|\s)(\d{1,4})(?=[A-Z]{2,}|A/L)", "$1$2 ")
    )


def email_of(value: Column) -> Column:
    """A mail address as given; empty where none is, null where the text is no address."""
    t = F.trim(text_of(value))
    #: fixed values
    form, longest = r"""^[^\s@<>(),;:"]+@[^\s@<>(),;:"]+\.[^\s@<>(),;:"]{2,}$""", 254
    return F.when(t == "", t).when(t.rlike(form) & (F.length(t) <= longest), t)


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(text_of(name), r"\.([A-Za-z0-9]+)$", 1))


#: File types that are pictures, and such that are read as text documents.
IMAGE_TYPES, DOCUMENT_TYPES = ("jpg", "jpeg", "png", "jfif", "bmp"), ("pdf", "csv", "xls", "xlsx", "txt")


def file_kind(name: Column) -> Column:
    """image, pdf (any document) or null, by a file's extension."""
    return F.when(extension(name).isin(*IMAGE_TYPES), "image").when(extension(name).isin(*DOCUMENT_TYPES), "pdf")


def is_data_name(name: Column) -> Column:
    """A plain name, without folders, of a known file type."""
    return ~text_of(name).rlike(r"[/\\]") & file_kind(name).isNotNull()


def file_type(name: Column) -> Column:
    """image for any picture, else the extension."""
    return F.when(extension(name).isin(*DOCUMENT_TYPES), extension(name)).otherwise("image")
