"""What a question asks for, as SQL expressions: a numbered section, a whole document, or neither."""

from __future__ import annotations

from .text import array, fold, folded_words

#: Words that name sections, requests for an overview, documents, and what may go with a bare request (fixed values).
SECTION_WORDS = "secao secoes capitulo clausula item parte topico section chapter clause part".split()
OVERVIEW_VERBS = (
    "explique explica explicar explicacao resuma resumir resumo sintetize sintese apresente descreva summarize summarise summary explain describe overview"
).split()
DOCUMENT_WORDS = "documento arquivo pdf relatorio texto document file report".split()
BARE_FILLERS = (
    "isso isto ele ela tudo me mim pra para por favor faca fazer um uma o a breve curto rapido rapidamente disso aqui this it please a an short brief quick me"
).split()
ABOUT = ("do que trata", "do que se trata", "sobre o que e", "what is this", "what's this")


def _roman(x: str) -> str:
    """The value of a Roman number of up to six digits."""
    value = lambda c: f"element_at(map('i', 1, 'v', 5, 'x', 10, 'l', 50, 'c', 100), {c})"
    digits = f"split({x}, '')"
    return (
        f"aggregate(transform(sequence(1, char_length({x})), i -> if(i < char_length({x}) and {value(f'get({digits}, i)')} > {value(f'get({digits}, i - 1)')}, "
        f"-{value(f'get({digits}, i - 1)')}, {value(f'get({digits}, i - 1)')})), 0, (s, v) -> s + v)")


def section_label(question: str) -> str:
    """The number of the section asked about, such as 3 or 3.2; Roman numbers become digits; null if there is none."""
    f = fold(question)
    words = "|".join(SECTION_WORDS)
    tokens = rf"""transform(regexp_extract_all({f}, '(?<![\\p{{L}}\\p{{N}}])(?:{words})(?![\\p{{L}}\\p{{N}}])[ nº°.#]*\\s*([a-z0-9.]+)', 1), t -> regexp_replace(t, '[.]+$', ''))"""
    number = r"t rlike '^[0-9]+([.][0-9]+)*$'"
    roman = f"(t rlike '^[ivxlc]{{1,6}}$' and {_roman('t')} > 0)"
    return f"get(transform(filter({tokens}, t -> {number} or {roman}), t -> if({number}, t, cast({_roman('t')} as string))), 0)"


def intent(question: str, in_document: str = "false") -> str:
    """section, overview or regular. In the scope of one document a bare request means that document."""
    w = folded_words(question)
    has = lambda words: f"arrays_overlap({w}, {array(sorted(set(words)))})"
    about = " or ".join("contains(" + fold(question) + ", '" + a.replace("'", "\\'") + "')" for a in ABOUT)
    bare = f"{in_document} and {has(OVERVIEW_VERBS)} and size(array_except({w}, {array(sorted(set(OVERVIEW_VERBS + BARE_FILLERS)))})) = 0"
    return f"case when {section_label(question)} is not null then 'section' when {has(DOCUMENT_WORDS)} and ({has(OVERVIEW_VERBS)} or {about}) or {bare} then 'overview' else 'regular' end"


def section_matches(section: str, label: str) -> str:
    """Whether a heading of the path *section* (parts joined by ' > ') begins with the number *label*."""
    rest = f"substring(h, char_length({label}) + 1)"
    fits = rf"({rest} = '' or {rest} rlike '^[\\s)\\-–]' or {rest} rlike '^[.]($|[0-9]|\\s|[^\\p{{L}}\\p{{N}}])')"
    return f"exists(split({section}, ' > '), h0 -> exists(array(trim(h0)), h -> startswith(h, {label}) and {fits}))"
