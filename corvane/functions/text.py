"""Text functions as Spark SQL expressions: every function takes and returns SQL, so all of them compose inside
one projection and stay in the JVM."""

from __future__ import annotations

import unicodedata
from functools import cache

#: Letters that folding maps to ASCII, and what they become (fixed values).
ACCENTED = "áàâãäéèêëíìîïóòôõöúùûüçñ"
PLAIN = "aaaaaeeeeiiiiooooouuuucn"

#: Marks that combine with the letter before them.
MARKS = "".join(map(chr, range(0x300, 0x370)))

#: Words that lexical search ignores (fixed values).
STOPWORDS = (
    "a o as os um uma de do da dos das em no na nos nas e ou que qual quais é são se por para com sem ao aos à às como "
    "quando onde meu minha the an of to in on and or is are what which how for with do does can i"
).split()

#: Abbreviations after which a full stop does not end a sentence (fixed values).
ABBREVIATIONS = (
    "dr dra sr sra srta prof profa eng av art arts inc par cap fig vol pág pag p pp ex obs cf etc nº n no ltda s.a mr mrs ms vs e.g i.e"
).split()

#: Field names whose values never reach a log, and prefixes of user paths (fixed values).
SENSITIVE = "text content quote query question answer prompt path file filename file_name title body chunk passage".split()
USER_PATHS = ("/Users/", "/Volumes/", "/private/", "/var/folders/", "/tmp/")


def lit(x: str) -> str:
    """A SQL string literal."""
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"


def array(words) -> str:
    return "array(" + ", ".join(map(lit, words)) + ")"


def collapse(t: str) -> str:
    """White-space runs become one space; ends are trimmed."""
    return rf"trim(regexp_replace({t}, '[\\s\\u0085\\p{{Z}}]+', ' '))"


def normalize_query(t: str) -> str:
    """Five ligatures expanded, controls to spaces, white space collapsed."""
    for a, b in (("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff")):
        t = f"replace({t}, '{a}', '{b}')"
    return collapse(rf"regexp_replace({t}, '\\p{{Cntrl}}', ' ')")


def fold(t: str) -> str:
    """Lower case without the diacritics of ACCENTED."""
    return f"translate(lower({t}), '{ACCENTED}', '{PLAIN}')"


@cache
def _plain_letters() -> tuple[str, str]:
    """Every lower-case letter of the Latin, Greek and Cyrillic blocks that decomposes, and what is left without its marks."""
    pairs = []
    for c in map(chr, (*range(0x80, 0x530), *range(0x1E00, 0x2000))):
        bare = "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn")
        if c.isalpha() and c == c.lower() and bare != c and len(bare) == 1:
            pairs.append((c, bare))
    return "".join(c for c, _ in pairs), "".join(b for _, b in pairs)


def search_fold(t: str) -> str:
    """Lower case without any diacritic, composed or not: how the search index reads words. One pass: letters are replaced, and
    combining marks, to which nothing corresponds, are dropped."""
    accented, plain = _plain_letters()
    return f"translate(lower({t}), '{accented}{MARKS}', '{plain}')"


def words(t: str) -> str:
    """Runs of letters and digits."""
    return rf"array_remove(split({t}, '[^\\p{{L}}\\p{{N}}]+', -1), '')"


def folded_words(t: str) -> str:
    return words(fold(t))


def search_words(t: str) -> str:
    return words(search_fold(t))


def terms(t: str) -> str:
    """Search terms in order of first use: lower case, no stop words, no single letters."""
    return rf"array_distinct(filter({words(f'lower({t})')}, w -> (char_length(w) > 1 or w rlike '^[0-9]$') and not array_contains({array(STOPWORDS)}, w)))"


def coverage(term_array: str, word_array: str) -> str:
    """Share of the (folded) terms found among the (folded) words; 1 without terms."""
    return f"if(size({term_array}) = 0, 1D, size(filter({term_array}, t -> array_contains({word_array}, t))) / cast(size({term_array}) as double))"


def trigrams(w: str) -> str:
    """The set of word trigrams of a word array; fewer than three words are one gram."""
    return f"array_distinct(if(size({w}) < 3, array(array_join({w}, ' ')), transform(sequence(0, greatest(size({w}) - 3, 0)), i -> concat_ws(' ', get({w}, i), get({w}, i + 1), get({w}, i + 2)))))"


def jaccard(a: str, b: str) -> str:
    """Jaccard similarity of two sets; 1 if both are empty."""
    return f"if(size(array_union({a}, {b})) = 0, 1D, size(array_intersect({a}, {b})) / cast(size(array_union({a}, {b})) as double))"


def numbers(w: str) -> str:
    """Words that hold an ASCII digit, in order."""
    return f"filter({w}, x -> x rlike '[0-9]')"


def contains_words(outer: str, inner: str) -> str:
    """Whether the words *inner* stand consecutively in *outer*; nothing contains no words."""
    return f"size({inner}) > 0 and contains(concat(' ', array_join({outer}, ' '), ' '), concat(' ', array_join({inner}, ' '), ' '))"


def join_adjacent(first: str, second: str) -> str:
    """Two texts as one: the longest run of words that ends the first and begins the second stands once."""
    a, b = (rf"array_remove(split({x}, '\\s+', -1), '')" for x in (first, second))
    # bound to names by a lambda over one row, so that each is computed once; most lengths fail at their outer words
    most = "least(size(p.a), size(p.b))"
    fits = f"n <= {most} and get(p.a, size(p.a) - n) = get(p.b, 0) and get(p.b, n - 1) = get(p.a, size(p.a) - 1) and slice(p.a, -n, n) = slice(p.b, 1, n)"
    n = f"coalesce(array_max(filter(sequence(1, greatest(1, {most})), n -> {fits})), 0)"
    rest = f"array_join(slice(p.b, {n} + 1, greatest(size(p.b), 1)), ' ')"
    bound = f"transform(array(named_struct('f', trim({first}), 'a', {a}, 'b', {b})), p -> named_struct('f', p.f, 'r', {rest}))"
    return f"element_at(transform({bound}, q -> case when q.r = '' then q.f when q.f = '' then q.r else concat(q.f, '\\n\\n', q.r) end), 1)"


def clean(t: str, folded: bool = True) -> str:
    """Line ends to ``\\n``, zero-width characters, soft hyphens and controls dropped; if *folded*, also
    exotic spaces to spaces and seven ligatures expanded."""
    t = rf"regexp_replace({t}, '\\r\\n?|[\\u2028\\u2029]', '\n')"
    t = rf"regexp_replace({t}, '[\\uFEFF\\u200B\\u2060\\u00AD]|[\\p{{Cc}}&&[^\\n\\t]]', '')"
    if folded:
        t = rf"regexp_replace({t}, '[\\u00A0\\u2000-\\u200A\\u202F\\u205F\\u3000]', ' ')"
        for a, b in (("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬅ", "st"), ("ﬆ", "st")):
            t = f"replace({t}, '{a}', '{b}')"
    return t


def single_line(t: str) -> str:
    return collapse(clean(t))


def kept_lines(t: str) -> str:
    """Each line collapsed, blank ones dropped."""
    return rf"array_join(array_remove(transform(split({clean(t)}, '\n', -1), x -> {collapse('x')}), ''), '\n')"


def block_text(kind: str, t: str) -> str:
    """A block's text by its kind: code keeps its spacing, records and tables keep their lines, all else is one line."""
    return f"case when {kind} = 'code' then {clean(t, False)} when {kind} in ('record', 'table') then {kept_lines(t)} else {single_line(t)} end"


def neutralize(t: str) -> str:
    """Angle brackets become guillemets, controls but line feed and tab go."""
    return rf"regexp_replace(translate({t}, '<>', '‹›'), '[\\p{{Cc}}&&[^\\n\\t]]', '')"


def attribute(t: str) -> str:
    """Neutralized, on one line, without double quotes."""
    return collapse(f"replace({neutralize(t)}, '\"', '\\'')")


def sensitive(field: str) -> str:
    return f"lower({field}) rlike '(^|_)({'|'.join(SENSITIVE)})$'"


def is_sensitive(field: str) -> bool:
    """The same for a name that is known while planning."""
    return any(field.lower() == x or field.lower().endswith("_" + x) for x in SENSITIVE)


def sanitize(t: str, most: int = 300) -> str:
    """User paths masked, long values cut."""
    masked = rf"""regexp_replace({t}, '({'|'.join(USER_PATHS)})[^\\s"\'\\)\\]\\}},]*', '<path>')"""
    return f"if(char_length({masked}) > {most}, concat(left({masked}, {most}), '…'), {masked})"


def chunk_tokens(t: str) -> str:
    """Tokens as chunking counts them: the larger of four thirds of the words and a quarter of the characters."""
    return rf"greatest(cast(ceil(4 * size(array_remove(split({t}, '\\s+', -1), '')) / 3D) as bigint), cast(ceil(char_length({t}) / 4D) as bigint))"


def prompt_tokens(t: str) -> str:
    """Tokens as prompts count them: a third of the characters."""
    return f"cast(ceil(char_length({t}) / 3D) as bigint)"


def fake_tokens(t: str) -> str:
    """Tokens as test doubles count them: a quarter of the characters."""
    return f"cast(ceil(char_length({t}) / 4D) as bigint)"


def sentences(t: str) -> str:
    """Sentences: end at . ! ? … before white space, but not after an initial or an abbreviation."""
    short = "|".join(a.replace(".", "\\\\.") for a in ABBREVIATIONS)
    guarded = rf"regexp_replace({t}, '(?i)(?<!\\S)((?:\\p{{L}}|{short})\\.)(?=\\s)', '$1\uE000')"
    marked = rf"regexp_replace({guarded}, '([.!?…])(?=\\s)', '$1\uE001')"
    return rf"filter(transform(split(replace({marked}, '\uE000', ''), '\uE001', -1), x -> regexp_replace(x, '^\\s+|\\s+$', '')), x -> x <> '')"


def title_of(file_name: str) -> str:
    """A title from a file name: without its extension, separators as spaces."""
    return rf"coalesce(nullif({collapse(rf"regexp_replace(regexp_replace({file_name}, '[.][^.]*$', ''), '[_-]+', ' ')")}, ''), {file_name})"


def conversation_title(t: str, most: int = 60) -> str:
    return f"if(char_length({collapse(t)}) > {most}, concat(trim(left({collapse(t)}, {most})), '…'), {collapse(t)})"


def margin_key(t: str) -> str:
    """Lines of page margins that differ in case and numbers only are alike."""
    return f"lower(regexp_replace({t}, '[0-9]', '#'))"


def page_number(t: str) -> str:
    """Whether a line is only a page number, perhaps with a word before it or a total after it."""
    bare = rf"regexp_replace(lower({t}), '^[-–\\s]+|[-–\\s]+$', '')"
    return rf"{bare} rlike '^(página|pagina|pág\\.|pág|page|p\\.)?[/\\s]*[0-9]{{1,5}}([/\\s]+((de|of)[/\\s]+)?[0-9]{{1,5}})?[/\\s]*$'"


def starts_list(t: str) -> str:
    """Whether a line begins a list item: a bullet, a number, or a letter with a parenthesis."""
    return rf"{t} rlike '^([•▪◦·‣–—*-]|\\(?[0-9]{{1,3}}[.)]|\\(?[a-z]\\))\\s'"


def dehyphenated(t: str) -> str:
    """Words that a line break cut are joined; other line breaks become spaces."""
    return rf"regexp_replace(regexp_replace({t}, '(\\p{{L}})-\n(\\p{{Ll}})', '$1$2'), '\\s*\n\\s*', ' ')"
