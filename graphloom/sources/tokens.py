"""Token trees of source files: one linear lexer per language family, comments and strings told apart from code.

A family's lexer is one regular expression that covers every character of a text, so ``regexp_extract_all`` cuts a file
into its tokens inside the JVM; possessive loops keep it linear and free of deep recursion, and a comment or literal that
is never closed runs to the end of the text or line.  Known limits: a regex literal of JavaScript is read as operators (a
quote in it opens a string up to the end of the line), a template literal is one string with all it interpolates, block
comments of Rust do not nest.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .code import language

LINE, BLOCK = r"//[^\n]*+", r"/\*(?:[\s\S]*?\*/|[\s\S]*+)"
DOUBLE = r'"[^"\\\n]*+(?:\\[\s\S][^"\\\n]*+)*+"?'
SINGLE = r"'[^'\\\n]*+(?:\\[\s\S][^'\\\n]*+)*+'?"
OPEN_DOUBLE = r'"[^"\\]*+(?:\\[\s\S][^"\\]*+)*+"?'  # over several lines
OPEN_SINGLE = r"'[^'\\]*+(?:\\[\s\S][^'\\]*+)*+'?"
BACKTICK = r"`[^`\\]*+(?:\\[\s\S][^`\\]*+)*+`?"
TRIPLE = r'"""(?:[\s\S]*?"""|[\s\S]*+)'
TRIPLE_SINGLE = r"'''(?:[\s\S]*?'''|[\s\S]*+)"
HASH = r"#[^\n]*+"
BEGIN = r"=begin\b(?:[\s\S]*?\n=end\b[^\n]*+|[\s\S]*+)"
VERBATIM = r'@"[^"]*+(?:""[^"]*+)*+"?'
RAW_C = r'R"\((?:[\s\S]*?\)"|[\s\S]*+)'
RAW_RUST = r'b?r#"(?:[\s\S]*?"#|[\s\S]*+)'
RUNE = r"'(?:\\[^\n][^'\n]*+|[^'\\\n])'|'[A-Za-z_][A-Za-z0-9_]*+"  # a character, or the name of a lifetime
PREFIX = r"(?:[rRbBuUfF]{1,2})?"

# What may stand first in a family: comments, then literals.
FAMILIES = {
    "script": ((LINE, BLOCK), (DOUBLE, SINGLE, BACKTICK)),
    "brace": ((LINE, BLOCK), (TRIPLE, VERBATIM, RAW_C, DOUBLE, SINGLE)),
    "rust": ((LINE, BLOCK), (RAW_RUST, OPEN_DOUBLE, RUNE)),
    "php": ((LINE, BLOCK, HASH), (OPEN_DOUBLE, OPEN_SINGLE)),
    "python": ((HASH,), (PREFIX + TRIPLE, PREFIX + TRIPLE_SINGLE, PREFIX + DOUBLE, PREFIX + SINGLE)),
    "ruby": ((HASH, BEGIN), (OPEN_DOUBLE, OPEN_SINGLE, BACKTICK)),
}
FAMILY_OF = {
    "typescript": "script", "javascript": "script", "go": "script", "java": "brace", "c": "brace", "cpp": "brace", "csharp": "brace", "kotlin": "brace", "swift": "brace", "scala": "brace",
    "rust": "rust", "php": "php", "python": "python", "shell": "ruby", "ruby": "ruby",
}
WORD = r"[A-Za-z_$\x{80}-\x{10FFFF}][A-Za-z0-9_$\x{80}-\x{10FFFF}]*+"
NUMBER = r"[0-9][0-9A-Za-z_.]*+"
BREAK, BLANK = r"\n[ \t]*+", r"[ \t\r\f\x0B]++"
OPERATOR = r"[=!]==|\.\.\.|=>|->|::|&&|\|\||\+\+|--|<<|>>|[-+*/%&|^=!<>]="


def lexer(family: str) -> str:
    """The expression whose successive matches are the tokens of a text."""
    comments, literals = FAMILIES[family]
    return "|".join((*comments, *literals, BREAK, BLANK, WORD, NUMBER, OPERATOR, r"[\s\S]"))


def plain(pattern: str) -> str:
    """The same expression without possessive loops, for engines that never go back."""
    return re.sub(r"(?<!\\)([*+])\+", r"\1", pattern)


def _by_family(lang: Column, f) -> Column:
    out = None
    for name in FAMILIES:
        test = lang.isin(*[k for k, v in FAMILY_OF.items() if v == name])
        out = F.when(test, f(name)) if out is None else out.when(test, f(name))
    return out


def tokens(text: Column, lang: Column) -> Column:
    """All tokens of a text in order, blanks included; null for a null text or a language without a lexer."""
    return _by_family(lang, lambda name: F.regexp_extract_all(text, F.lit(lexer(name)), F.lit(0)))


def token_class(token: Column, lang: Column) -> Column:
    """comment, string, space, word, number or symbol.  Strings with a prefix are told from words by their quote."""

    def of(name: str) -> Column:
        comments, literals = FAMILIES[name]
        whole = lambda parts: "^(?:" + "|".join(parts) + ")$"
        first = F.when(F.ltrim(token, F.lit(" \t\r\f\x0b\n")) == "", "space")
        return first.when(token.rlike(whole(comments)), "comment").when(token.rlike("['\"`]") & token.rlike(whole(literals)), "string").when(token.rlike(whole([WORD])), "word").when(token.rlike(whole([NUMBER])), "number").otherwise("symbol")

    return _by_family(lang, of)


def code_only(text: Column, lang: Column, keep_strings: bool = False) -> Column:
    """The text with comments (and the insides of strings) gone and every line where it was, for parsers by line."""

    def blank(t: Column) -> Column:
        kind = token_class(t, lang)
        lines = F.regexp_replace(t, r"[^\n]++", "")
        mark = F.substring(F.regexp_replace(t, "^[A-Za-z@]++", ""), 1, 1)
        return F.when(kind == "comment", lines).when((kind == "string") & ~F.lit(keep_strings), F.concat(mark, lines, mark)).otherwise(t)

    return F.array_join(F.transform(tokens(text, lang), blank), "")


def canonical(text: Column, lang: Column) -> Column:
    """The code of a text, a blank between any two tokens: equal for two texts that differ in comments and layout only.

    Python keeps where a line begins and how deep, other languages do not; a Python call set over several lines differs
    from the same call on one.  Null for a null text or a language without a lexer, empty where there is no code."""
    indents = lang == "python"
    kept = F.filter(tokens(text, lang), lambda t: F.when(F.startswith(t, F.lit("\n")), indents).otherwise(~token_class(t, lang).isin("comment", "space")))
    joined = F.array_join(kept, " ")
    lines = F.regexp_replace(F.concat(F.lit("\n "), joined), r"\n[ \t]*+(?=\n|$)", "")  # lines without code
    return F.when(indents, F.regexp_replace(lines, r"^\n | $", "")).otherwise(joined)


def token_table(files: DataFrame, comments: bool = True) -> DataFrame:
    """Tokens of files (path, text; paths are unique) without blanks: path, language, pos, token, class, line (from 1) and depth.

    The depth of a token is the number of brackets open around it; an opening and its closing bracket have the same one.
    A closing bracket too many counts below zero rather than being lost.  Files without text or lexer have no rows.  A
    window goes over one file, which is a single row of ``files`` as well.  Without ``comments`` these have no rows, and their texts are
    not shuffled."""
    f = files.select("path", "text", language(F.col("path")).alias("language"))
    t = f.select("path", "language", F.posexplode(tokens(F.col("text"), F.col("language"))).alias("pos", "token"))
    t = t.withColumn("class", token_class(F.col("token"), F.col("language")))
    opens, closes = F.col("token").isin("(", "[", "{"), F.col("token").isin(")", "]", "}")
    step = F.when(F.col("class") != "symbol", 0).when(opens, 1).when(closes, -1).otherwise(0)
    breaks = F.length("token") - F.length(F.replace(F.col("token"), F.lit("\n"), F.lit("")))
    before = W.partitionBy("path").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    t = t.withColumn("step", step).withColumn("breaks", breaks)
    unseen = ("space",) if comments else ("space", "comment")
    t = t.withColumn("token", F.when(~F.col("class").isin(*unseen), F.col("token")))
    t = t.withColumn("line", 1 + F.coalesce(F.sum("breaks").over(before), F.lit(0))).withColumn("above", F.coalesce(F.sum("step").over(before), F.lit(0)))
    depth = F.col("above") + F.when(F.col("step") == -1, -1).otherwise(0)
    return t.where(~F.col("class").isin(*unseen)).select("path", "language", "pos", "token", "class", F.col("line").cast("int").alias("line"), depth.cast("int").alias("depth"))


# How a file is written for matching: every token as SEP token MARK line, brackets with MARK depth after that.
SEP, MARK = "\x1f", "\x1e"
_END = f"(?={SEP})"
_VARIABLE = re.compile(r"(\$\$)?\$([A-Z_][A-Z0-9_]*)")


def compile_pattern(pattern: str, lang: str) -> tuple[str, list[tuple[str, int]], list[str]]:
    """(expression over a written file, (variable, group) in order, words that a matching file must hold).

    A pattern is code of its language in which ``$X`` stands for one token or one bracket with all it holds, and ``$$$X``
    for whatever is left inside the bracket around it.  The same name twice asks for the same code.  Every part fits in one way only, so
    a match never depends on which way was tried first."""
    family = FAMILIES[FAMILY_OF[lang]]
    lex = re.compile(lexer(FAMILY_OF[lang]).replace(r"\x{80}-\x{10FFFF}", "\x80-\U0010ffff"))
    comments = re.compile("|".join(family[0]))
    parts = [t for t in lex.findall(pattern) if t.strip() and not comments.fullmatch(t)]
    if not parts:
        raise ValueError("an empty pattern")
    out, groups, variables, words, open_at = [], 1, [], [], []  # group 1 is the whole match

    def until_closed(group: int) -> str:
        return f"(?:(?!{SEP}[)\\]}}]{MARK}\\d+{MARK}\\{group}{_END})[\\s\\S])*+"

    for k, t in enumerate(parts):
        var = _VARIABLE.fullmatch(t)
        if var and var[1]:
            if not open_at or k + 1 == len(parts) or parts[k + 1] not in ")]}":
                raise ValueError(f"{t} must be the last part inside a bracket")
            groups += 1
            variables.append((var[2], groups))
            out.append(f"({until_closed(open_at[-1])})")
        elif var:
            groups += 2
            variables.append((var[2], groups - 1))
            bracket = f"{SEP}[(\\[{{]{MARK}\\d+{MARK}(-?\\d+){_END}{until_closed(groups)}{SEP}[)\\]}}]{MARK}\\d+{MARK}\\{groups}{_END}"
            out.append(f"({SEP}[^{SEP}{MARK}]++{MARK}\\d+{_END}|{bracket})")
        elif t in "([{":
            groups += 1
            open_at.append(groups)
            out.append(f"{SEP}\\{t}{MARK}\\d+{MARK}(-?\\d+){_END}")
        elif t in ")]}":
            if not open_at:
                raise ValueError("a bracket is closed that was not opened")
            out.append(f"{SEP}\\{t}{MARK}\\d+{MARK}\\{open_at.pop()}{_END}")
        else:
            words.append(t)
            out.append(f"{SEP}{re.sub(r'([^A-Za-z0-9_ ])', lambda m: chr(92) + m[1] if m[1] < chr(128) else m[1], t)}{MARK}\\d+{_END}")
    if open_at:
        raise ValueError("a bracket is not closed")
    return f"(?=({''.join(out)}))", variables, words


def written(files: DataFrame) -> DataFrame:
    """(path, language, code): each file's tokens without comments, written as patterns expect them."""
    t = token_table(files, comments=False)
    clean = F.replace(F.replace(F.col("token"), F.lit(SEP), F.lit(" ")), F.lit(MARK), F.lit(" "))  # on whole literals: far faster than by character
    bracket = (F.col("class") == "symbol") & F.col("token").isin("(", "[", "{", ")", "]", "}")
    one = F.concat(F.lit(SEP), clean, F.lit(MARK), F.col("line").cast("string"), F.when(bracket, F.concat(F.lit(MARK), F.col("depth").cast("string"))).otherwise(""))
    parts = F.array_sort(F.collect_list(F.struct("pos", one.alias("s"))))
    return t.groupBy("path", "language").agg(F.concat(F.array_join(F.transform(parts, lambda x: x["s"]), ""), F.lit(SEP)).alias("code"))


def _bare(code: Column) -> Column:
    return F.trim(F.replace(F.regexp_replace(code, f"{MARK}[-0-9{MARK}]++", ""), F.lit(SEP), F.lit(" ")))


def match_patterns(files: DataFrame, patterns: list[tuple[str, str, str]]) -> DataFrame:
    """Matches of (pattern id, language, pattern) in files (path, text): path, pattern_id, line, matched, bindings.

    Overlapping and nested matches are all found, comments and layout do not matter, strings are tokens.  Files that lack a word of
    every pattern are dropped before they are cut into tokens; all patterns share one pass."""
    compiled = [(pid, lang, *compile_pattern(text, lang)) for pid, lang, text in patterns]
    lang = language(F.col("path"))
    may = F.lit(False)
    for _, of, _, _, words in compiled:
        test = lang == of
        for w in words:
            test = test & F.contains("text", F.lit(w))
        may = may | test
    found = []
    for pid, of, rx, variables, _ in compiled:
        hits = F.when(F.col("language") == of, F.regexp_extract_all("code", F.lit(rx), F.lit(1)))
        inner = "^" + rx[3:-1]  # the same groups, from the start of a match

        def hit(m: Column) -> Column:  # called at once, so it may use the loop's names
            again = F.concat(m, F.lit(SEP))
            bound = [(name, _bare(F.regexp_extract(again, inner, g))) for name, g in variables]
            first = dict(reversed(bound))
            same = F.lit(True)
            for name, value in bound:
                if value is not first[name]:
                    same = same & (value == first[name])
            pairs = [x for name, value in first.items() for x in (F.lit(name), value)]
            return F.struct(
                F.lit(pid).alias("pattern_id"), F.regexp_extract(m, f"{MARK}(\\d+)", 1).cast("int").alias("line"), _bare(m).alias("matched"),
                (F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")).alias("bindings"), same.alias("same"),
            )

        found.append(F.coalesce(F.transform(hits, hit), F.array().cast("array<struct<pattern_id:string,line:int,matched:string,bindings:map<string,string>,same:boolean>>")))
    # Texts that cannot match become null rather than being filtered: a filter would go below what makes the texts and make them twice.
    w = written(files.select("path", F.when(may, F.col("text")).alias("text")))
    return w.select("path", F.explode(F.concat(*found)).alias("m")).where("m.same").select("path", "m.pattern_id", "m.line", "m.matched", "m.bindings")
