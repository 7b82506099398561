"""Recognizers and conversions of cell values, as SQL expressions: numbers, dates, booleans, spreadsheet serials."""

from __future__ import annotations

from .text import array

#: Cells that are booleans (fixed values).
BOOLEANS = ("true", "false", "sim", "não", "nao", "verdadeiro", "falso", "yes", "no")

#: Built-in spreadsheet formats that show dates or times (fixed values).
DATE_FORMATS = (14, 15, 16, 17, 18, 19, 20, 21, 22, 27, 30, 36, 45, 46, 47)


def is_number(c: str) -> str:
    """Currency sign, percent signs and spaces do not count; with both marks, the point groups thousands."""
    x = rf"regexp_replace(replace({c}, 'R$', ''), '[% \\u00A0]', '')"
    x = f"if(contains({x}, '.') and contains({x}, ','), replace(replace({x}, '.', ''), ',', '.'), replace({x}, ',', '.'))"
    return rf"{x} rlike '^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$'"


def is_date(c: str) -> str:
    """Year first or day first, with -, / or . and perhaps a time."""
    time = r"([T ][0-9]{1,2}:[0-9]{1,2}(:[0-9]{1,2}([.][^:]*)?)?Z*)?$"
    month, day = "0?[1-9]|1[0-2]", "0?[1-9]|[12][0-9]|3[01]"
    return rf"({c} rlike '^[0-9]{{4}}([-/.])({month})\\1({day}){time}' or {c} rlike '^({day})([-/.])({month})\\2[0-9]{{4}}{time}')"


def is_boolean(c: str) -> str:
    return f"array_contains({array(BOOLEANS)}, lower({c}))"


def cell_kind(c: str) -> str:
    """number, date, boolean or text; null for an empty cell."""
    return f"case when {c} is null or trim({c}) = '' then null when {is_number(f'trim({c})')} then 'number' when {is_date(f'trim({c})')} then 'date' when {is_boolean(f'trim({c})')} then 'boolean' else 'text' end"


def serial_to_text(x: str, since_1904: bool = False) -> str:
    """A spreadsheet serial as text: a date, with hour and minute if it is not a whole day; null out of
    range. The 1900 system counts a day that never was as 60."""
    days = f"cast(floor({x}) as int)"
    day = f"date_add(date'1904-01-01', {days})" if since_1904 else f"if({days} > 60, date_add(date'1899-12-30', {days}), date_add(date'1899-12-31', {days}))"
    seconds = f"cast(round(({x} - floor({x})) * 86400) as int)"
    clock = f"concat(lpad(cast({seconds} div 3600 % 24 as string), 2, '0'), ':', lpad(cast({seconds} div 60 % 60 as string), 2, '0'))"
    return f"case when isnan({x}) or not ({x} >= 0 and {x} < 2958466) then null when {seconds} = 0 then cast({day} as string) else concat(cast({day} as string), ' ', {clock}) end"


def is_date_format(code: str) -> str:
    """Whether a number format shows a date or time: d, m, y, h or s outside quotes, brackets and escapes."""
    bare = rf"""regexp_replace(lower({code}), '"[^"]*"|\\[[^\\]]*\\]|\\\\.|_.|\\*.', '')"""
    return f"{bare} rlike '[dmyhs]'"


def pdf_date(x: str) -> str:
    """``D:YYYYMMDDHHmmSS...`` as ISO text; null if there is no valid date."""
    m = rf"regexp_extract({x}, '^(?:D:)?([0-9]{{4}})([0-9]{{2}})?([0-9]{{2}})?([0-9]{{2}})?([0-9]{{2}})?([0-9]{{2}})?', %d)"
    part = lambda k, d: f"coalesce(nullif({m % k}, ''), '{d}')"
    date = f"try_to_date(concat_ws('-', {part(1, '')}, {part(2, '01')}, {part(3, '01')}))"
    return f"if({date} is null, null, concat(cast({date} as string), if({m % 4} = '', '', concat('T', concat_ws(':', {part(4, '00')}, {part(5, '00')}, {part(6, '00')})))))"
