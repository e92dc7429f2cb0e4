"""Markup residue: which formats a text holds leftovers of, and the text without them, structure kept.

Chosen method: one grammar per format. The detection half is a set of anchored patterns evaluated in the
JVM; the conversion half turns every construct into plain text with `#` headings, `- ` items,
`a | b` table rows, fenced code and formulas between dollar signs. Page differencing finds lines that pages share;
it can tell neither which format a line holds nor convert it, so it isn't used (see the README).
"""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldloom.operators.html import HEADINGS, OPEN, TEXT
from fieldloom.operators.html import events as html_events
from fieldloom.operators.html import span as html_span
from fieldloom.session import table

#: fixed values: elements whose tags count as HTML
TAGS = "a|abbr|article|aside|b|big|blockquote|body|br|button|caption|center|cite|code|col|colgroup|dd|del|details|div|dl|dt|em|figcaption|figure|font|footer|form|h[1-6]|head|header|hr|html|i|iframe|img|input|ins|kbd|label|li|link|main|mark|meta|nav|ol|option|p|pre|q|s|samp|script|section|select|small|source|span|strike|strong|style|sub|summary|sup|svg|table|tbody|td|template|textarea|tfoot|th|thead|title|tr|tt|u|ul|var|video|wbr"
_RULE = r"^[ \t]*\|?[ \t]*:?-{3,}:?[ \t]*(?:\|[ \t]*:?-{3,}:?[ \t]*)++\|?[ \t]*$"
_WIKI_HEAD = r"^(={2,6})[ \t]*([^=\s][^=\n]*?)[ \t]*\1[ \t]*$"
_SETEXT = r"^([^\n=|>#`\s][^\n]*)\n={3,}[ \t]*$"
PATTERNS = {
    "html": [rf"(?i)</?(?:{TAGS})(?:\s[^<>]*)?/?>", r"<!--", r"(?i)<!doctype", r"&(?:[A-Za-z]{2,8}[0-9]{0,2}|#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6});"],
    "markdown": [
        r"(?m)^ {0,3}#{1,6}[ \t]+\S", r"(?m)^ {0,3}(?:```|~~~)", r"!?\[[^\[\]\n]*\]\([^()\s]+(?:\s\"[^\"\n]*\")?\)", r"\*\*[^\s*](?:[^*\n]*[^\s*])?\*\*", r"(?<!`)`[^`\n]+`(?!`)",
        rf"(?m){_RULE}", r"(?m)^[ \t]*[-*+] \[[ xX]\] ", r"(?m)^ {0,3}>[ \t]+\S", rf"(?m){_SETEXT}", r"~~[^~\s][^~\n]*~~",
    ],
    "wiki": [r"\[\[[^\[\]\n]+\]\]", r"\{\{[^{}\n]+\}\}", r"(?m)^\{\|", r"(?m)^\|[-}]", rf"(?m){_WIKI_HEAD}", r"'{2,3}[^'\n]+'{2,3}", r"(?m)^![^\n]*!!"],
    "latex": [r"(?<![A-Za-z0-9:\\])\\[A-Za-z]{2,}", r"[\p{IsHan}。，]\\[A-Za-z]{2,}", r"(?s)\\\[.*?\\\]", r"(?s)\\\(.*?\\\)", r"\$(?=[^$\n]*[\\^_=])[^$\s0-9][^$\n]*\$", r"\$\$[^$]+\$\$"],
}


def kinds(df: DataFrame, row_id: str, text: str) -> DataFrame:
    """(row_id, kind) for each format that occurs; null and empty texts hold none. JVM only, no shuffle."""
    tests = [F.when(F.greatest(*(F.col(text).rlike(p) for p in ps)), F.lit(k)) for k, ps in PATTERNS.items()]
    found = F.filter(F.array(*tests), lambda k: k.isNotNull())
    return df.select(row_id, F.explode(found).alias("kind"))


# --- conversion: a tokenizer for each format -----------------------------------------------------

_FENCE = re.compile(r"^(```|~~~)[^\n]*\n(.*?)(?:^\1[ \t]*$|\Z)", re.M | re.S)
_PRE = re.compile(r"<pre[^<>]*>(?:\s*<code[^<>]*>)?(.*?)(?:</code>\s*)?</pre>", re.I | re.S)
_VERBATIM = re.compile(r"\\begin\{(verbatim|lstlisting)\}(?:\[[^\]\n]*\])?\n?(.*?)(?:\\end\{\1\}|\Z)", re.S)
_MATH = re.compile(r"\\\[(.*?)\\\]|\\\((.*?)\\\)|\$\$([^$]+)\$\$|\$((?=[^$\n]*[\\^_=])[^$\s0-9][^$\n]*)\$", re.S)
_TAG = re.compile(rf"<(/?)({TAGS})((?:\s[^<>]*)?)/?>", re.I)
_NO_TAG = re.compile(rf"<(?!/?(?:{TAGS})(?:\s[^<>]*)?/?>|!--|!doctype)", re.I)
#: fixed values: unit names of the units package, with their signs; commands whose arguments stand for nothing in a text; signs written as commands
UNITS = {"newton": "N", "metre": "m", "pascal": "Pa", "mega": "M", "kilo": "k", "litre": "L", "celsius": "°C", "percent": "%", "ampere": "A", "volt": "V", "per": "/", "second": "s", "minute": "min", "hour": "h", "bar": "bar", "gram": "g", "degree": "°"}
SILENT = {"label", "ref", "cite", "vspace", "hspace", "usepackage", "documentclass", "includegraphics", "pagestyle", "bibliography", "hline", "toprule", "midrule", "bottomrule", "centering", "maketitle", "newpage", "noindent", "cline"}
SIGNS = {"times": "×", "cdot": "·", "pm": "±", "leq": "≤", "le": "≤", "geq": "≥", "ge": "≥", "neq": "≠", "approx": "≈", "degree": "°", "circ": "°", "Omega": "Ω", "omega": "ω", "mu": "μ", "alpha": "α", "beta": "β", "Delta": "Δ", "delta": "δ", "eta": "η", "rho": "ρ", "pi": "π", "phi": "φ", "Phi": "Φ", "ldots": "…", "dots": "…", "quad": " ", "qquad": " ", "to": "→", "rightarrow": "→"}
HEADS = {"part": 1, "chapter": 1, "section": 1, "subsection": 2, "subsubsection": 3, "paragraph": 4}


def _row(cells: list[str]) -> str:
    return " | ".join(re.sub(r"\s*\n\s*", " ", c).strip() for c in cells)


def _from_html(x: str) -> str:
    """Elements by their events: headings, numbered and plain items with their depth, table rows with spans filled, line ends of blocks; other tags go."""
    page = html_events(_NO_TAG.sub("&lt;", x))
    out: list[str] = []
    lists: list[int | None] = []  # the next number of an open ordered list, None of a plain one
    tables: list[list[list[tuple[str, int, int]]]] = []
    cells: list[tuple[list[str], dict]] = []  # what stood before the open cell
    for kind, value, attrs in page:
        if kind == TEXT:
            if not (tables and not cells and not value.strip()):
                out.append(value)
        elif kind == OPEN:
            if value in HEADINGS:
                out.append(f"\n{HEADINGS[value]} ")
            elif value in ("ul", "ol"):
                out += ["\n"] * (not lists)
                lists.append(1 if value == "ol" else None)
            elif value == "li":
                number = lists[-1] if lists else None
                lead = "- " if number is None else f"{number}. "
                if number is not None:
                    lists[-1] = number + 1
                out.append("\n" + "  " * max(len(lists) - 1, 0) + lead)
            elif value == "table":
                tables.append([])
                out.append("\n")
            elif value == "tr" and tables:
                tables[-1].append([])
            elif value in ("td", "th") and tables:
                if not tables[-1]:
                    tables[-1].append([])
                cells.append((out, attrs))
                out = []
            elif value == "img":
                out.append(attrs.get("alt", ""))
            elif value in _LINES:
                out.append("\n")
        elif value in ("td", "th") and cells and tables:
            text = "".join(out)
            out, own = cells.pop()
            tables[-1][-1].append((text, html_span(own.get("colspan")), html_span(own.get("rowspan"))))
        elif value == "table" and tables:
            out += [_row(r) + "\n" for r in _grid(tables.pop())]
        elif value in ("ul", "ol"):
            if lists:
                lists.pop()
            out += ["\n"] * (not lists)
        elif value in HEADINGS or value in _LINES:
            out.append("\n")
    return "".join(out).replace("\xa0", " ")


_LINES = {"br", "p", "div", "section", "article", "blockquote", "hr", "dl", "dt", "dd", "caption", "pre", "figure", "figcaption", "main", "header", "footer", "nav", "aside", "body", "html", "head", "title"}


def _grid(rows: list[list[tuple[str, int, int]]]) -> list[list[str]]:
    """Rows of cells, those that a span covers filled: with its text below, with nothing beside."""
    taken: dict[tuple[int, int], str] = {}
    for r, cells in enumerate(rows):
        c = 0
        for text, wide, tall in cells:
            while (r, c) in taken:
                c += 1
            for i in range(wide):
                for down in range(min(tall, len(rows) - r)):
                    taken[r + down, c + i] = "" if i else text
            c += wide
    width = [1 + max((c for y, c in taken if y == r), default=-1) for r in range(len(rows))] if len(rows) < 50 else _widths(taken, len(rows))
    return [[taken.get((r, c), "") for c in range(w)] for r, w in enumerate(width) if w]


def _widths(taken: dict[tuple[int, int], str], rows: int) -> list[int]:
    out = [0] * rows
    for r, c in taken:
        out[r] = max(out[r], c + 1)
    return out


_WIKI_TOKEN = re.compile(r"\{\{|\}\}|\[\[|\]\]|\|")


def _from_wiki(x: str) -> str:
    """Headings, tables of one or several cells a line, links, and templates of any nesting: `name: argument, argument`."""
    x = re.sub(_WIKI_HEAD, lambda m: f"{'#' * (len(m[1]) - 1)} {m[2]}", x, flags=re.M)
    x = _wiki_tables(x) if "{|" in x else x
    frames: list[tuple[str, list[str]]] = [("", [""])]
    at = 0
    closing = {"{{": "}}", "[[": "]]"}
    for m in _WIKI_TOKEN.finditer(x):
        kind, parts = frames[-1]
        parts[-1] += x[at : m.start()]
        at = m.end()
        t = m[0]
        if t in closing:
            frames.append((t, [""]))
        elif t == "|" and kind:
            parts.append("")
        elif kind and t == closing[kind]:
            frames.pop()
            frames[-1][1][-1] += _link(parts) if kind == "[[" else parts[0].strip() + (": " + ", ".join(p.strip() for p in parts[1:]) if len(parts) > 1 else "")
        else:
            parts[-1] += t
    frames[-1][1][-1] += x[at:]
    while len(frames) > 1:  # what isn't closed is text
        kind, parts = frames.pop()
        frames[-1][1][-1] += kind + "|".join(parts)
    return re.sub(r"'{2,3}([^'\n]+)'{2,3}", r"\1", frames[0][1][0])


def _link(parts: list[str]) -> str:
    """A link's text is its last part; a category or an interlanguage link has none."""
    return parts[-1].strip() if len(parts) > 1 or ":" not in parts[0] else parts[0].rpartition(":")[2].strip()


def _wiki_tables(x: str) -> str:
    out: list[str] = []
    rows: list[list[str]] | None = None
    for line in x.split("\n"):
        bare = line.strip()
        if rows is None and bare.startswith("{|"):
            rows = [[]]
        elif rows is None:
            out.append(line)
        elif bare.startswith("|}"):
            out += [_row(r) for r in rows if r] + [bare[2:]] * bool(bare[2:])
            rows = None
        elif bare.startswith("|-"):
            rows.append([])
        elif bare.startswith("|+"):
            out.append(bare[2:].strip())
        elif bare[:1] in ("|", "!"):
            cells = re.split(r"\|\||!!" if bare[0] == "!" else r"\|\|", bare[1:])
            rows[-1] += [re.sub(r"^[^|\[{]*=[^|\[{]*\|(?!\|)", "", c).strip() for c in cells]  # without the cell's attributes
        elif rows[-1]:
            rows[-1][-1] += " " + bare
    return "\n".join(out + [_row(r) for r in rows or [] if r])


_TEX_TOKEN = re.compile(r"(?:(?<![A-Za-z0-9:\\])\\(?P<name>[A-Za-z]{2,})|\\(?P<taking>[A-Za-z]+)(?=\*?\{))\*?|(?P<line>\\\\(?:\[[^\]\n]*\])?(?=[\s\\]|\Z)[ \t]*\n?)|\\(?P<sign>[%&#_${}])|[{}&]|(?<=[}一-鿿])~(?=[\w\\])|\[[^\[\]\n]*\]")


def _from_latex(x: str) -> str:
    """Commands with all their arguments, environments, items and tables; a stack of open groups, so any nesting. Text without a command stays as it is."""
    if not _TEX_TOKEN.search(x) or "\\" not in x:
        return x
    #: a frame is a group: the command it is an argument of, that command's arguments so far, the text before it
    out: list[str] = []
    frames: list[tuple[list[str], str | None, list[str]]] = []
    command: str | None = None
    args: list[str] = []
    envs: list[str] = []
    numbers: list[int] = []
    at = 0

    def finish() -> None:
        nonlocal command, args
        if command is not None:
            out.append(_command(command, args, envs, numbers))
            command, args = None, []

    for m in _TEX_TOKEN.finditer(x):
        between = x[at : m.start()]
        t = m[0]
        if between and (between.strip(" ") or t != "{"):
            finish()
            out.append(between)
        at = m.end()
        if name := m["name"] or m["taking"]:
            finish()
            command = name
        elif t == "{" and command is not None:
            frames.append((out, command, args))
            out, command, args = [], None, []
        elif t == "}" and frames:
            finish()
            text = "".join(out)
            out, command, args = frames.pop()
            args.append(text)
        elif t[0] == "[" and command is not None:
            pass  # an option
        elif m["sign"]:
            finish()
            out.append(m["sign"])
        elif m["line"]:
            finish()
            out.append("\n")
        else:
            finish()
            in_table = bool(envs) and envs[-1] in ("tabular", "tabularx", "array", "longtable")
            out.append("\x01" if t == "&" and in_table else " " if t == "~" else t)
    finish()
    out.append(x[at:])
    while frames:  # a group that isn't closed is text
        text = "".join(out)
        out, command, args = frames.pop()
        out += [_command(command, args, envs, numbers)] * (command is not None) + [text]
        command = None
    x = re.sub(r"[ \t]*\x01[ \t]*", " | ", "".join(out))
    return re.sub(r"\s*\x04([^\x04]*)\x04[ \t]*", r"\n\1 ", x)


def _command(name: str, args: list[str], envs: list[str], numbers: list[int]) -> str:
    if name == "begin":
        envs.append(args[0] if args else "")
        numbers.append(0)
        return ""
    if name == "end":
        if envs:
            envs.pop()
            numbers.pop()
        return ""
    if name == "item":
        if envs and envs[-1] == "enumerate":
            numbers[-1] += 1
            return f"\x04{numbers[-1]}.\x04" + "".join(args)
        return "\x04-\x04" + "".join(args)
    if name in HEADS:
        return f"\n{'#' * HEADS[name]} {args[0] if args else ''}\n"
    if name in ("frac", "dfrac", "tfrac") and len(args) == 2:
        wrap = lambda a: a if re.fullmatch(r"[\w.]*", a) else f"({a})"
        return f"{wrap(args[0])}/{wrap(args[1])}"
    if name in ("SI", "qty") and args:
        return args[0] + (" " + _units(args[1]) if len(args) > 1 else "")
    if name in ("si", "unit") and args:
        return _units(args[0])
    if name in ("href", "textcolor") and len(args) == 2:
        return args[1]
    if name == "sqrt" and args:
        return f"√({args[0]})"
    if name in SILENT:
        return ""
    return " ".join(args) if args else SIGNS.get(name, UNITS.get(name, ""))


def _units(x: str) -> str:
    return "".join(UNITS.get(u, u) for u in re.findall(r"[A-Za-z]+|[^A-Za-z\s\\]+", x))


_EMPHASIS = re.compile(r"\*\*([^\s*](?:[^*\n]*[^\s*])?)\*\*|__(?=\S)([^_\n]+?)(?<=\S)__(?!\w)|~~([^~\s][^~\n]*)~~|(?<![\w*])\*([^\s*](?:[^*\n]*[^\s*])?)\*(?![\w*])|(?<![\w_])_([^\s_](?:[^_\n]*[^\s_])?)_(?![\w_])")


def _from_markdown(x: str) -> str:
    """Rules of tables go, their rows lose the outer pipes; links, images, emphasis, code, tasks and quotes become their text."""
    notes = {m[1].lower() for m in re.finditer(r"^ {0,3}\[([^\]\n^]+)\]:[ \t]+\S+.*$", x, re.M)}
    if notes:
        x = re.sub(r"^ {0,3}\[([^\]\n^]+)\]:[ \t]+\S+.*\n?", "", x, flags=re.M)
        x = re.sub(r"!?\[([^\[\]\n]+)\]\[([^\[\]\n]*)\]", lambda m: m[1] if (m[2] or m[1]).lower() in notes else m[0], x)
    table = re.search(rf"(?m){_RULE}", x) is not None
    x = re.sub(_RULE + r"\n?", "", x, flags=re.M)
    x = re.sub(_SETEXT, r"# \1", x, flags=re.M)
    x = re.sub(r"^[ \t]*\|([^\n]*)\|[ \t]*$", lambda m: _row(m[1].split("|")) if "|" in m[1] or table else m[0], x, flags=re.M)
    x = re.sub(r"!?\[([^\[\]\n]*)\]\([^()\s]+(?:\s\"[^\"\n]*\")?\)", r"\1", x)
    for _ in range(3):  # bold around italic around struck
        if (y := _EMPHASIS.sub(lambda m: next(g for g in m.groups() if g is not None), x)) == x:
            break
        x = y
    x = re.sub(r"^([ \t]*)[-*+] \[[ xX]\] ", r"\1- ", x, flags=re.M)
    x = re.sub(r"^([ \t]*)[*+] (?=\S)", r"\1- ", x, flags=re.M)
    x = re.sub(r"(?<!`)`([^`\n]+)`(?!`)", r"\1", x)
    return re.sub(r"^ {0,3}(?:>[ \t]?)+", "", x, flags=re.M)


def clean(text: str | None) -> str | None:
    """Plain text with headings, lists, tables, code blocks and formulas kept. Null stays null; text without markup comes back as it is, but for blank runs."""
    if text is None:
        return None
    kept: list[str] = []

    def keep(s: str) -> str:
        kept.append(s)
        return f"\x02{len(kept) - 1}\x03"

    x = re.sub("[\x01-\x04]", "", text)
    x = _FENCE.sub(lambda m: "\n" + keep("```\n" + m[2].rstrip("\n") + "\n```") + "\n", x)
    x = _PRE.sub(lambda m: "\n" + keep("```\n" + html.unescape(_TAG.sub("", m[1])).strip("\n") + "\n```") + "\n", x)
    x = _VERBATIM.sub(lambda m: "\n" + keep("```\n" + m[2].strip("\n") + "\n```") + "\n", x)
    x = _MATH.sub(lambda m: keep("$" + next(g for g in m.groups() if g is not None).strip() + "$"), x)
    x = _from_html(_from_latex(_from_wiki(_from_markdown(x))))
    x = re.sub(r"\x02(\d+)\x03", lambda m: kept[int(m[1])], x)
    x = re.sub(r"[ \t]+$", "", x, flags=re.M)
    return re.sub(r"\n{3,}", "\n\n", x).strip("\n")


@F.pandas_udf(T.StringType())
def _clean(s: pd.Series) -> pd.Series:
    return s.map(clean)


#: what any converter changes begins with one of these; rows without them stay in the JVM
_MAYBE = r"[<&`*_~\\$\x01-\x04]|\[\[|\{\{|\{\||''|\]\(|\]\[|\]:|(?m)^[ \t]*[|>+]|^={2,}|^[ \t]*\|?[ \t]*:?-{3,}"


def with_clean(df: DataFrame, text: str, name: str) -> DataFrame:
    """Add the clean text; only rows that may hold markup go to Python."""
    t = F.col(text)
    marked = F.coalesce(t.rlike(_MAYBE), F.lit(False))
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r"(?m)[ \t]+$", ""), r"\n{3,}", "\n\n"), r"\A\n+|\n+\z", "")
    return df.where(marked).withColumn(name, _clean(t)).unionByName(df.where(~marked).withColumn(name, bare))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kinds(table(spark, sf_dir, "index_documents"), "doc_id", "text")


def p3_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record's text and each of its fields as clean text."""
    d = table(spark, sf_dir, "index_documents").select("doc_id", "text", "fields")
    rows = d.select("doc_id", F.explode(F.map_concat(F.create_map(F.lit("text"), F.col("text")), F.coalesce(F.map_filter("fields", lambda k, v: k != "text"), F.create_map().cast("map<string,string>")))).alias("field", "value"))
    return with_clean(rows, "value", "clean").select("doc_id", "field", "clean")
