"""Markup residue in text documents: HTML, wiki, LaTeX and Markdown to clean text that keeps its structure.

HTML goes through the events of the standard library's streaming parser; each output line has its text and its tags
counted, the text-to-tag ratios are smoothed by a Gaussian and parted at a threshold, and lines of the low part that
are only links are left out. The other kinds are rewritten by rule. Kept are headings (``#``), lists (``-``, ``1.``), table
rows (cells parted by `` | ``), code (fences, backquotes) and formulas (between dollars).
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from html import unescape
from html.entities import html5
from html.parser import HTMLParser

# Names of HTML elements, and of the wiki's own element.
HTML_NAMES = frozenset(
    "a abbr address area article aside audio b base bdi bdo big blockquote body br button canvas caption center cite "
    "code col colgroup data dd del details dfn dialog div dl dt em embed fieldset figcaption figure font footer form "
    "frame frameset h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd label legend li link main map "
    "mark meta meter nav noscript object ol optgroup option output p param picture pre progress q s samp script "
    "section select small source span strike strong style sub summary sup svg table tbody td template textarea tfoot "
    "th thead time title tr tt u ul var video wbr nowiki ref references".split()
)
_BLOCKS = frozenset("address article aside blockquote body center dd div dl dt fieldset figcaption figure footer form header html main nav p section summary caption".split())
_HIDDEN = frozenset("script style head title template ref references noscript".split())

# --- what counts as a construct ---------------------------------------------------------------------------------

_TAG = re.compile(r"""<(/?)([A-Za-z][A-Za-z0-9]*)((?:\s+[A-Za-z_:@][-\w:.]*(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'=<>`]+))?)*\s*)(/?)>""")
_COMMENT = re.compile(r"<!--|<!DOCTYPE\b|<!\[CDATA\[|<\?xml\b", re.I)
_REFERENCE = re.compile(r"&(?:#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});")
_MARKDOWN = re.compile(
    r"""(?mx)
    ^[ ]{0,3}\#{1,6}[ \t]+\S                                  # heading
  | ^[ ]{0,3}[^\s|>#*+=-][^\n|]*\n[ ]{0,3}(?:={2,}|-{2,})[ \t]*\r?$    # underlined heading
  | ^[ ]{0,3}(?:```|~~~)                                      # fenced code
  | (?<![`\w])(`+)(?=[^`\n])[^`\n]+?\1(?!`)                   # code
  | !?\[[^\[\]\n]*\]\([^()\s]+(?:[ \t]+"[^"\n]*")?\)          # link, image
  | ^[ ]{0,3}>[ \t]+(?![\d<>=])\S                             # quote
  | ^[ \t]*[-*+][ \t]+(?![\d<>=*+-])[^\s|]                    # list
  | (?<![\w*\\])(\*{1,3})(?=[^\s*])[^*\n]*[^\s*]\2(?![\w*])   # emphasis
  | (?<![\w_\\])(_{1,3})(?=[^\s_])[^_\n]*[^\s_]\3(?![\w_])
  | (?<![\w~])~~(?=[^\s~])[^~\n]*[^\s~]~~(?![\w~])
    """
)
#: Two lines of one mark after another are a list or a quote also where their items begin with a digit.
_LISTED = re.compile(r"(?m)^([ \t]*[-*+]|[ ]{0,3}>)[ \t]+\d[^\n|]*\n\1[ \t]+\d")
_RULE_LINE = re.compile(r"(?m)^[^\n]*\|[^\n]*\n[ \t]*(?=[^\n]*\|)(?!\|-+[ \t]*\r?$)\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*\r?$")
_WIKI = re.compile(
    r"""(?mx)
    ^[ \t]*(={2,6})[^=\n][^\n]*?\1[ \t]*\r?$                      # heading
  | (?<!')(?:'{2,3}|'{5})(?=[^'\s])[^'\n]*(?:'[^'\n]+)*?'{2,5}    # quoted emphasis
  | \[\[[^\[\]\n]+\]\]                                            # link
  | \[(?:https?|ftp)://[^\s\]]+[ ][^\]\n]+\]
  | \{\{[^{}]+\}\}                                                # template
  | ^[ \t]*\{\|                                                   # table
    """
)
_LATEX = re.compile(
    r"""(?mx)
    \\(?:begin|end)\{[A-Za-z]+\*?\}                               # environment
  | (?<![:\\/])\\[A-Za-z]{2,}\*?(?=[\[{])                           # command
  | (?<![\w:\\/])\\(?:item|hline|newline|par|noindent|centering|maketitle|tableofcontents|toprule|midrule|bottomrule|LaTeX|TeX|ldots|dots|newpage|clearpage)(?![\w\\])
  | \\\((?=[^\n]*?\\\))  | \\\[(?=[\s\S]*?\\\])                   # formula
  | \$\$[^$]+\$\$
  | (?<![\w$\\])\$(?=[^\s$])(?=[^$\n]*[\\^_=<>+{])[^$\n]*[^\s$]\$(?![\w$])
  | (?<![\w$\\])\$[A-Za-z]\$(?![\w$])
    """
)


def _is_tag(m: re.Match, text: str) -> bool:
    """A tag of a known name; a bare label in capitals such as <MENU> only beside its end tag, or if it stands alone by rule."""
    name = m[2]
    if name.lower() not in HTML_NAMES:
        return False
    if name.isupper() and len(name) > 1 and not (m[1] or m[3].strip() or m[4]) and name not in ("BR", "HR"):
        return f"</{name}>" in text
    return True


class _Events(HTMLParser):
    """Constructs as the streaming parser meets them: its events say where one may be, and of what kind it is; the text
    between them is handed on, to be searched for the kinds that have no parser."""

    def __init__(self, source: str):
        super().__init__(convert_charrefs=False)
        self.source = source
        self.found = False
        self.starts = [0]
        for line in source.split("\n")[:-1]:
            self.starts.append(self.starts[-1] + len(line) + 1)
        self.feed(source)
        self.close()

    def _place(self) -> int:
        line, offset = self.getpos()
        return self.starts[line - 1] + offset

    def _tag(self, raw: str) -> None:
        """A region the parser took for a tag; one that runs over others, for want of its end, holds theirs."""
        self.found |= any(_is_tag(m, self.source) for m in _TAG.finditer(raw))

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self._tag(self.get_starttag_text() or "")

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self._tag(self.get_starttag_text() or "")

    def handle_endtag(self, tag: str) -> None:
        at = self._place()
        m = _TAG.match(self.source, at)
        self.found |= bool(m and _is_tag(m, self.source))

    def handle_comment(self, data: str) -> None:
        self.found |= bool(_COMMENT.match(self.source, self._place()))

    handle_decl = handle_pi = unknown_decl = handle_comment

    def _reference(self, _: str) -> None:
        m = _REFERENCE.match(self.source, self._place())
        self.found |= bool(m and (m[0][1] == "#" or m[0][1:] in html5))

    handle_entityref = handle_charref = _reference

    def handle_data(self, data: str) -> None:
        """Text, and what no event says: a tag or comment that is never closed, or one inside a script."""
        if "<" in data:
            self._tag(data)
            self.found |= bool(_COMMENT.search(data))


def kinds(text: str | None) -> list[str]:
    """Kinds of markup a text has a construct of, out of html, latex, markdown, wiki.

    HTML comes from the events of the parser; the other kinds have none and are found by their constructs' form.
    """
    if not text:
        return []
    text = text.replace("\r\n", "\n")
    out = ["html"] if ("<" in text or "&" in text) and _Events(text).found or "<!--" in text else []
    if ("\\" in text or "$" in text) and _LATEX.search(text):
        out.append("latex")
    if _MARKDOWN.search(text) or "|" in text and _RULE_LINE.search(text) or _LISTED.search(text):
        out.append("markdown")
    if _WIKI.search(text):
        out.append("wiki")
    return out


# --- what no rule may touch ----------------------------------------------------------------------------------------

# Commands that make a formula of their arguments.
_MATHS = "frac dfrac tfrac sqrt sum prod int binom overline underline vec hat bar mathrm mathbf mathit".split()
_BRACED = r"\{(?:[^{}]|\{(?:[^{}]|\{[^{}]*\})*\})*\}"
_MATH_ENVIRONMENTS = "equation|align|displaymath|math|gather|eqnarray"
_FENCE = re.compile(r"(?m)^ {0,3}(```+|~~~+)[^\n]*\n([\s\S]*?)(?:^ {0,3}\1[ \t]*$|\Z)")
_VERBATIM = re.compile(r"\\begin\{(verbatim|lstlisting)\}(?:\[[^\]]*\])?\n?([\s\S]*?)\n?\\end\{\1\}")
_PRE = re.compile(r"(?i)<pre(?:\s[^<>]*)?>\n?([\s\S]*?)\n?</pre\s*>")
_CODE_TAG = re.compile(r"(?i)<(code|tt|kbd|samp)(?:\s[^<>]*)?>([\s\S]*?)</\1\s*>")
_NOWIKI = re.compile(r"(?i)<nowiki>([\s\S]*?)</nowiki>")
_MATH_TAG = re.compile(r"(?i)<math(?:\s[^<>]*)?>([^<>]*?)</math\s*>")
_CODE = re.compile(r"(?<![`\w])(`+)(?!`)([^\n]+?)(?<!`)\1(?!`)")
_FORMULA = re.compile(
    rf"\$\$([^$]+)\$\$|\\\[([\s\S]*?)\\\]|\\\(([^\n]*?)\\\)|\\begin\{{(?:{_MATH_ENVIRONMENTS})\*?\}}([\s\S]*?)\\end\{{(?:{_MATH_ENVIRONMENTS})\*?\}}"
    r"|(?<![\w$\\])\$(?=\S)([^$\n]*?\S)\$(?![\w$])"
)
_BARE_MATH = re.compile(rf"(?:\\(?:{'|'.join(_MATHS)})(?![A-Za-z])(?:\[[^\[\]]*\])?(?:{_BRACED})+[ ^_]*)+(?<! )")


class _Held:
    """Code and formulas taken out of a text before anything is rewritten, and put back at the end."""

    def __init__(self, text: str):
        # Marks need a character the text does not hold; among so many one is free.
        self.mark = next(c for c in map(chr, range(0xE000, 0xF8FF)) if c not in text)
        self.parts: list[str] = []

    def put(self, clean: str) -> str:
        self.parts.append(clean)
        return f"{self.mark}{len(self.parts) - 1}{self.mark}"

    def back(self, text: str) -> str:
        pattern = re.compile(f"{self.mark}(\\d+){self.mark}")
        while pattern.search(text):  # a formula may stand in what was taken out after it
            text = pattern.sub(lambda m: self.parts[int(m[1])], text)
        return text


def _literal(html: str) -> str:
    """Text of code in HTML: tags of known names go, references are resolved, all else stays."""
    return unescape(_TAG.sub(lambda m: "" if m[2].lower() in HTML_NAMES else m[0], html))


def _protected(text: str, found: list[str]) -> tuple[str, _Held]:
    held = _Held(text)
    block = lambda code: "\n" + held.put(f"```\n{code.strip(chr(10))}\n```") + "\n"
    inline = lambda code: held.put(f"`{code}`") if code else ""
    text = _FENCE.sub(lambda m: held.put(f"```\n{m[2].strip(chr(10))}\n```"), text)
    if "latex" in found:
        text = _VERBATIM.sub(lambda m: block(m[2]), text)
    if "html" in found:
        text = _PRE.sub(lambda m: block(_literal(m[1])), text)
        text = _NOWIKI.sub(lambda m: held.put(unescape(m[1])), text)
        text = _MATH_TAG.sub(lambda m: held.put("$" + unescape(m[1]).strip() + "$"), text)
    if "markdown" in found:
        text = _CODE.sub(lambda m: held.put(m[0]), text)
    if "html" in found:
        text = _CODE_TAG.sub(lambda m: inline(_literal(m[2])), text)
    if "latex" in found:
        text = _FORMULA.sub(lambda m: held.put("$" + next(g for g in m.groups() if g is not None).strip() + "$"), text)
        text = _BARE_MATH.sub(lambda m: held.put(f"${m[0]}$"), text)
    return text, held


# --- HTML ---------------------------------------------------------------------------------------------------------


class _Lines(HTMLParser):
    """Lines of text with the tags met on each."""

    def __init__(self, source: str):
        super().__init__(convert_charrefs=True)
        self.source = source
        self.lines: list[list] = [["", 0, False, 0]]  # text, tags, structure, characters of links
        self.lists: list[str | int] = []
        self.hidden = self.link = self.pre = self.drawing = 0
        self.unseen: list[str] = []  # text since a hidden element opened, restored where that is never closed
        self.row: list[str] | None = None
        self.feed(source)
        self.close()
        if self.hidden and self.unseen:
            self.hidden = 0
            self.handle_data("".join(self.unseen))
        self._end_row()

    def _new(self, start: str = "", structure: bool = False) -> None:
        if self.row is not None:
            return
        if self.lines[-1][0].strip() or self.lines[-1][1]:
            self.lines.append(["", 0, False, 0])
        self.lines[-1][0] += start
        self.lines[-1][2] |= structure

    def _add(self, text: str) -> None:
        if self.row is not None and self.row:
            self.row[-1] += text
        else:
            self.lines[-1][0] += text
        if self.link:
            self.lines[-1][3] += len(text.strip())

    def _end_row(self) -> None:
        if self.row is not None:
            cells, self.row = [" ".join(c.split()) for c in self.row], None
            if any(cells):
                self._new(" | ".join(cells), True)
            self._new()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("svg", "math"):
            self.drawing += 1
        if self.drawing and tag not in HTML_NAMES:  # parts of a drawing
            self.lines[-1][1] += 1
            return
        if tag == "body":  # whatever of the head was left open ends here
            self.hidden, self.unseen = 0, []
        if tag not in HTML_NAMES or not _TAG.match(self.get_starttag_text() or "") or not _is_tag(_TAG.match(self.get_starttag_text()), self.source):
            self._add(self.get_starttag_text() or "")
            return
        self.lines[-1][1] += 1
        if tag in _HIDDEN:
            self.hidden += 1
            self.hidden_by = tag
        elif tag in ("tr", "table"):
            self._end_row()
            self._new()
            if tag == "tr":
                self.row = []
        elif tag in ("td", "th"):
            if self.row is None:
                self._new()
                self.row = []
            self.row.append("")
        elif re.fullmatch("h[1-6]", tag):
            self._new("#" * int(tag[1]) + " ", True)
        elif tag in ("ul", "ol"):
            self.lists.append("-" if tag == "ul" else 0)
            self._new()
        elif tag == "li":
            mark = "-"
            if self.lists and self.lists[-1] != "-":
                self.lists[-1] += 1
                mark = f"{self.lists[-1]}."
            self._new(mark + " ", True)
        elif tag == "pre":
            self._new()
            self._new("```", True)
            self._new("", True)
            self.pre += 1
        elif tag in ("code", "tt", "kbd", "samp"):
            if not self.pre:
                self._add("`")
        elif tag in ("br", "hr"):
            self._add(" ") if self.row is not None else self._new()
        elif tag in ("sup", "sub"):
            self._add("^" if tag == "sup" else "_")
        elif tag == "img":
            self._add(dict(attrs).get("alt") or "")
        elif tag == "a":
            self.link += 1
        elif tag in _BLOCKS:
            self._new()

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag in ("svg", "math"):
            self.drawing -= 1
        if tag in _HIDDEN:
            self.hidden -= 1

    def handle_endtag(self, tag: str) -> None:
        self.lines[-1][1] += 1
        if tag in ("svg", "math"):
            self.drawing = max(0, self.drawing - 1)
        if tag in _HIDDEN:
            self.hidden = max(0, self.hidden - 1)
            if not self.hidden:
                self.unseen = []
        elif tag in ("tr", "table", "tbody", "thead"):
            self._end_row()
        elif tag == "pre" and self.pre:
            self.pre -= 1
            self._new("```", True)
            self._new()
        elif tag in ("code", "tt", "kbd", "samp"):
            if not self.pre:
                self._add("`")
        elif tag in ("ul", "ol") and self.lists:
            self.lists.pop()
            self._new()
        elif tag == "a":
            self.link = max(0, self.link - 1)
        elif tag in _BLOCKS or tag == "li" or re.fullmatch("h[1-6]", tag):
            self._new()

    def handle_data(self, data: str) -> None:
        if self.hidden:
            if self.hidden_by not in ("script", "style"):
                self.unseen.append(data)
            return
        parts = data.replace("\xa0", " ").replace("\u202f", " ").split("\n")
        for i, part in enumerate(parts):
            if i:
                self._add(" ") if self.row is not None else self._new("", bool(self.pre))
            self._add(part)


def content_lines(lines: list[list], sigma: float = 1.0) -> list[bool]:
    """Whether each line is content: its smoothed text-to-tag ratio reaches the threshold, or it is more than links."""
    ratios = [len(text.strip()) / max(1, tags) for text, tags, _, _ in lines]
    reach = max(1, round(3 * sigma))
    kernel = [math.exp(-(d * d) / (2 * sigma * sigma)) for d in range(-reach, reach + 1)]
    smooth = []
    for i in range(len(ratios)):
        near = [(kernel[d + reach], ratios[i + d]) for d in range(-reach, reach + 1) if 0 <= i + d < len(ratios)]
        smooth.append(sum(k * r for k, r in near) / sum(k for k, _ in near))
    threshold = _two_clusters(smooth)
    return [s >= threshold or structure or link * 2 < len(text.strip()) for s, (text, _, structure, link) in zip(smooth, lines)]


def _two_clusters(values: list[float]) -> float:
    """The middle between the means of a low and a high cluster; 0 if there is only one."""
    low, high = min(values, default=0.0), max(values, default=0.0)
    for _ in range(20):
        middle = (low + high) / 2
        under, over = [v for v in values if v < middle], [v for v in values if v >= middle]
        if not under or not over:
            return 0.0
        now = sum(under) / len(under), sum(over) / len(over)
        if now == (low, high):
            break
        low, high = now
    return (low + high) / 2


def _from_html(text: str) -> str:
    if re.search(r"&lt;/?[A-Za-z!]", text) and not any(_is_tag(m, text) for m in _TAG.finditer(text)):
        text = unescape(text)
    parser = _Lines(text)
    keep = content_lines(parser.lines)
    return "\n".join(line[0].rstrip() for line, kept in zip(parser.lines, keep) if kept and line[0].strip())


# --- wiki, LaTeX, Markdown ------------------------------------------------------------------------------------------


def _cells(line: str, parter: str) -> str:
    return " | ".join(c.strip() for c in line.split(parter))


def _repeated(pattern: str, by: str | Callable[[re.Match], str], text: str) -> str:
    """``text`` with matches replaced from the inside out, until none is left; each must take braces away."""
    found = 1
    while found:
        text, found = re.subn(pattern, by, text)
    return text


def _template(m: re.Match) -> str:
    """What a template was given; its name too where that names its parts, as of a box, and where it was given nothing."""
    name, given = m[1].strip(), [p.strip() for p in m[2].split("|") if p.strip()]
    boxed = any(re.match(r"[A-Za-z]\w*\s*=", p) for p in given)
    return f"{name}: {', '.join(given)}" if boxed and name else ", ".join(given) or (name if not m[2] else "")


def _from_wiki(text: str) -> str:
    text = re.sub(r"<ref\b[^>/]*/>|<ref\b[^>]*>.*?</ref>", "", text, flags=re.S)
    text = re.sub(r"(?m)^[ \t]*(={2,6})[ \t]*([^=\n].*?)[ \t]*\1[ \t]*$", lambda m: "#" * len(m[1]) + " " + m[2], text)
    text = re.sub(r"\[\[(?:File|Image|Datei|Fichier|Archivo):[^\[\]|]*((?:\|[^\[\]|]*)*)\]\]", lambda m: (m[1].split("|")[-1]).strip(), text)
    text = re.sub(r"\[\[(?:[^\[\]|]*\|)?([^\[\]|]*)\]\]", r"\1", text)
    text = re.sub(r"\[(?:https?|ftp)://\S+ ([^\]\n]+)\]", r"\1", text)
    text = _repeated(r"\{\{([^{}|]*)\|?([^{}]*)\}\}", _template, text)
    text = re.sub(r"'{2,5}(?=\S)([^\n]*?\S)'{2,5}", r"\1", text)
    out, inside = [], False
    for line in text.split("\n"):
        bare = line.strip()
        if bare.startswith("{|"):
            inside = True
        elif inside and bare.startswith("|}"):
            inside = False
        elif inside and bare.startswith(("|-", "|+")):
            if bare.startswith("|+"):
                out.append(bare[2:].strip())
        elif inside and bare.startswith(("!", "|")):
            out.append(_cells(bare[1:], "!!" if bare[0] == "!" else "||"))
        else:
            out.append(line)
    return "\n".join(out)


_SECTIONS = {"part": 1, "chapter": 1, "section": 1, "subsection": 2, "subsubsection": 3, "paragraph": 4, "subparagraph": 5}


def _from_latex(text: str) -> str:
    def rows(m: re.Match) -> str:
        lines = (re.sub(r"\\[hc]line(?:\{[^}]*\})?|\\(?:top|mid|bottom)rule", "", r).strip() for r in m[1].split("\\\\"))
        return "\n".join(re.sub(r"\s*(?<!\\)&\s*", " | ", r) for r in lines if r)

    text = re.sub(r"\\begin\{(?:tabular|array|longtable)\*?\}(?:\{(?:[^{}]|\{[^{}]*\})*\})*([\s\S]*?)\\end\{(?:tabular|array|longtable)\*?\}", rows, text)

    number = [0]

    def items(m: re.Match) -> str:
        number[0] = 0
        numbered = m[1] == "enumerate"

        def mark(_: re.Match) -> str:
            number[0] += 1
            return f"\n{number[0]}. " if numbered else "\n- "

        return re.sub(r"\s*\\item(?:\[[^\]]*\])?\s*", mark, m[2]).strip()

    text = re.sub(r"\\begin\{(itemize|enumerate|description)\}([\s\S]*?)\\end\{\1\}", items, text)
    text = re.sub(r"\\(?:begin|end)\{[A-Za-z]+\*?\}(?:\[[^\]]*\])?", "", text)
    text = re.sub(rf"\\({'|'.join(_SECTIONS)})\*?\{{([^{{}}]*)\}}", lambda m: "#" * _SECTIONS[m[1]] + " " + m[2] + "\n", text)
    text = re.sub(r"\\SI\{([^{}]*)\}\{([^{}]*)\}", lambda m: m[1] + " " + m[2].replace("\\", " ").strip(), text)
    text = re.sub(r"\\(?:label|ref|cite|pageref)\{[^{}]*\}", "", text)
    text = _repeated(r"(?<![:\\/])\\[A-Za-z]{2,}\*?(?:\[[^\]]*\])?\{([^{}]*)\}", r"\1", text)
    text = re.sub(r"(?<![\w:\\/])\\(?:item|hline|newline|par|noindent|centering|maketitle|toprule|midrule|bottomrule|newpage|clearpage)(?![\w\\])\s?", "", text)
    text = re.sub(r"(?<![\w:])\\([%&#$_{}])", r"\1", text)
    return re.sub(r"(?<=\d)~(?=\S)", " ", text)


def _from_markdown(text: str) -> str:
    text = re.sub(r"(?m)^ {0,3}([^\s|>#*+=-][^\n|]*)\n {0,3}(={2,}|-{2,})[ \t]*$", lambda m: ("# " if m[2][0] == "=" else "## ") + m[1].strip(), text)
    listed = bool(_LISTED.search(text))
    out, code = [], False
    for line in text.split("\n"):
        if re.match(r" {0,3}(?:```|~~~)", line):
            code = not code
            out.append("```")
            continue
        if code:
            out.append(line)
            continue
        if out and "|" in line and "|" in out[-1] and re.fullmatch(r"\s*\|?\s*:?-+:?\s*(?:\|\s*:?-+:?\s*)*\|?\s*", line):
            continue
        if re.match(r"\s*\|.*\|\s*$", line):
            line = _cells(line.strip().strip("|"), "|")
        line = re.sub(r"^( {0,3}#{1,6})[ \t]+(.*?)[ \t]*#*$", lambda m: m[1].strip() + " " + m[2], line)
        digit = "" if listed else r"\d"
        line = re.sub(rf"^ {{0,3}}>[ \t]+(?![{digit}<>=])", "", line)
        line = re.sub(rf"^([ \t]*)[*+-][ \t]+(?![{digit}<>=*+-])(?=\S)", r"\1- ", line)
        line = re.sub(r"!?\[([^\[\]\n]*)\]\([^()\s]+(?:[ \t]+\"[^\"\n]*\")?\)", r"\1", line)
        spans = re.split(r"(`+[^`]+`+)", line)
        for i in range(0, len(spans), 2):
            s = re.sub(r"(?<![\w*\\])(\*{1,3})(?=[^\s*])([^*\n]*[^\s*])\1(?![\w*])", r"\2", spans[i])
            s = re.sub(r"(?<![\w_\\])(_{1,3})(?=[^\s_])([^_\n]*[^\s_])\1(?![\w_])", r"\2", s)
            spans[i] = re.sub(r"(?<![\w~])~~(?=[^\s~])([^~\n]*[^\s~])~~(?![\w~])", r"\1", s)
        out.append("".join(spans))
    return "\n".join(out)


def clean(text: str | None) -> tuple[str | None, list[str]]:
    """The clean text and the kinds of markup found; a text without markup, empty or null comes back unchanged."""
    found = kinds(text)
    if not found:
        return text, found
    out, held = _protected(text.replace("\r\n", "\n"), found)
    if "wiki" in found:
        out = _from_wiki(out)
    if "latex" in found:
        out = _from_latex(out)
    if "markdown" in found:
        out = _from_markdown(out)
    if "html" in found:
        out = _from_html(out)
    return re.sub(r"\n{3,}", "\n\n", held.back(out)).strip(), found
