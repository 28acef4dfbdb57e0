"""Markdown to HTML by the rules of CommonMark, with tables and struck-out text; raw HTML stays text.

Blocks: containers (quotes, list items) are cut out with their prefixes taken off and read again as lines of their own;
paragraphs go on lazily inside them. Inlines: code spans, links, images and breaks first, then delimiter runs are matched on a
stack. The HTML only serves the block parser of pages, so attributes that make no block are left out.
"""

from __future__ import annotations

import html
import re
import unicodedata

_ATX = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))??(?:[ \t]+#+)?[ \t]*$")
_RULE = re.compile(r" {0,3}([-*_])(?:[ \t]*\1){2,}[ \t]*$")
_FENCE = re.compile(r"( {0,3})(`{3,}(?=[^`]*$)|~{3,})(.*)$")
_QUOTE = re.compile(r" {0,3}> ?")
_ITEM = re.compile(r"( {0,3})(?:([-+*])|(\d{1,9})([.)]))(?=[ \t]|$)")
_SETEXT = re.compile(r" {0,3}(=+|-+)[ \t]*$")
_DELIMITERS = re.compile(r" {0,3}\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")
_DEFINITION = re.compile(r""" {0,3}\[((?:[^\\\[\]]|\\.)+)\]:[ \t]*\n?[ \t]*(<[^<>\n]*>|[^\s<]\S*)(?:[ \t]*\n?[ \t]+(?:"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|\((?:[^()\\]|\\.)*\)))?[ \t]*(?:\n|$)""")
_PUNCT = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def _expanded(line: str) -> str:
    """Leading tabs as spaces up to the next fourth column."""
    out, i = "", 0
    while i < len(line) and line[i] in " \t":
        out += " " if line[i] == " " else " " * (4 - len(out) % 4)
        i += 1
    return out + line[i:]


def _begins_block(line: str, in_paragraph: bool = True) -> bool:
    """Whether a line ends a paragraph before it."""
    if _ATX.match(line) or _RULE.match(line) or _FENCE.match(line) or _QUOTE.match(line):
        return True
    m = _ITEM.match(line)
    return bool(m) and (not in_paragraph or bool(line[m.end() :].strip()) and m[3] in (None, "1"))


def _goes_on(taken: list[str], line: str) -> bool:
    """Whether a line without the container's prefix goes on with a paragraph at the container's end."""
    if not line.strip() or _begins_block(line) or not taken or not taken[-1].strip():
        return False
    rest, inside = taken, True
    while inside:  # what the last line is, inside of all containers
        last = rest[-1]
        m = _QUOTE.match(last)
        n = _ITEM.match(last)
        inside = bool(m) or bool(n) and not _RULE.match(last)
        rest = [last[m.end() :] if m else last[n.end() :].lstrip()] if inside else rest
    fences = sum(bool(_FENCE.match(x)) for x in taken)
    return bool(rest[-1].strip()) and not (_ATX.match(rest[-1]) or _RULE.match(rest[-1]) or fences % 2 or rest[-1].startswith("    ") and len(taken) == 1)


class _Reader:
    def __init__(self) -> None:
        self.links: dict[str, str] = {}

    # ---- blocks

    def render(self, lines: list[str], tight: bool = False) -> str:
        out, i = [], 0
        while i < len(lines):
            line = lines[i]
            if not line.strip():
                i += 1
            elif line.startswith("    "):
                end = i
                while end < len(lines) and (lines[end].startswith("    ") or not lines[end].strip()):
                    end += 1
                body = "\n".join(x[4:] for x in lines[i:end]).rstrip("\n ")
                out.append(f"<pre>{html.escape(body, False)}\n</pre>")
                i = end
            elif m := _FENCE.match(line):
                close = re.compile(rf" {{0,3}}{re.escape(m[2][0])}{{{len(m[2])},}}[ \t]*$")
                end = next((j for j in range(i + 1, len(lines)) if close.match(lines[j])), len(lines))
                body = "\n".join(re.sub(rf"^ {{0,{len(m[1])}}}", "", x) for x in lines[i + 1 : end])
                out.append(f"<pre>{html.escape(body, False)}\n</pre>")
                i = end + 1
            elif m := _ATX.match(line):
                out.append(f"<h{len(m[1])}>{self.inline((m[2] or '').strip())}</h{len(m[1])}>")
                i += 1
            elif _RULE.match(line):
                out.append("<hr>")
                i += 1
            elif _QUOTE.match(line):
                body: list[str] = []
                while i < len(lines) and (_QUOTE.match(lines[i]) or _goes_on(body, lines[i])):
                    body.append(_expanded(_QUOTE.sub("", lines[i], count=1)) if _QUOTE.match(lines[i]) else lines[i])
                    i += 1
                out.append(f"<blockquote>{self.render(body)}</blockquote>")
            elif m := _ITEM.match(line):
                i = self._list(lines, i, m, out)
            elif self._is_table(lines, i):
                i = self._table(lines, i, out)
            else:
                i = self._paragraph(lines, i, out, tight)
        return "\n".join(out)

    def _list(self, lines: list[str], i: int, first: re.Match, out: list[str]) -> int:
        kind, items = first[2] or first[4], []
        while i < len(lines):
            m = _ITEM.match(lines[i])
            if not m or (m[2] or m[4]) != kind or _RULE.match(lines[i]):
                break
            rest = lines[i][m.end() :]
            gap = len(rest) - len(rest.lstrip(" ")) if rest.strip() else 1
            offset = m.end() + (gap if 1 <= gap <= 4 else 1)
            body = [_expanded(lines[i][offset:])]
            i += 1
            if not body[0].strip() and i < len(lines) and not lines[i].strip():
                items.append([])  # an item begins with at most one blank line
                continue
            while i < len(lines):
                line = lines[i]
                if not line.strip():
                    following = next((x for x in lines[i:] if x.strip()), "")
                    if len(following) - len(following.lstrip(" ")) < offset:
                        break
                    body.append("")
                elif len(line) - len(line.lstrip(" ")) >= offset:
                    body.append(line[offset:])
                elif _goes_on(body, line) and not _ITEM.match(line):
                    body.append(line.lstrip())
                else:
                    break
                i += 1
            items.append(body)
            j = i
            while j < len(lines) and not lines[j].strip():
                j += 1
            if j > i and j < len(lines) and (n := _ITEM.match(lines[j])) and (n[2] or n[4]) == kind and not _RULE.match(lines[j]):
                i = j
        tag = "ul" if first[2] else "ol"
        out.append(f"<{tag}>" + "".join(f"<li>{self.render(x, True)}</li>" for x in items) + f"</{tag}>")
        return i

    @staticmethod
    def _cells(line: str) -> list[str]:
        body = re.sub(r"(?<!\\)\|$", "", line.strip().removeprefix("|"))
        return [c.strip().replace("\\|", "|") for c in re.split(r"(?<!\\)\|", body)]

    def _is_table(self, lines: list[str], i: int) -> bool:
        return i + 1 < len(lines) and "|" in lines[i] + lines[i + 1] and bool(_DELIMITERS.match(lines[i + 1])) and len(self._cells(lines[i])) == len(self._cells(lines[i + 1]))

    def _table(self, lines: list[str], i: int, out: list[str]) -> int:
        head = self._cells(lines[i])
        rows, i = [], i + 2
        while i < len(lines) and lines[i].strip() and not _begins_block(lines[i], False) and not lines[i].startswith("    "):
            rows.append((self._cells(lines[i]) + [""] * len(head))[: len(head)])
            i += 1
        line = lambda tag, cells: "<tr>" + "".join(f"<{tag}>{self.inline(c)}</{tag}>" for c in cells) + "</tr>"
        out.append(f"<table>{line('th', head)}{''.join(line('td', r) for r in rows)}</table>")
        return i

    def _paragraph(self, lines: list[str], i: int, out: list[str], tight: bool) -> int:
        kept, level = [], 0
        while i < len(lines) and lines[i].strip() and not level:
            if kept and (m := _SETEXT.match(lines[i])):
                level = 1 if m[1][0] == "=" else 2
            elif kept and (_begins_block(lines[i]) or self._is_table(lines, i)):
                break
            else:
                kept.append(lines[i].strip(" \t") if not lines[i].endswith("  ") else lines[i].lstrip(" \t"))
            i += 1
        body = "\n".join(kept)
        while m := _DEFINITION.match(body):
            self.links.setdefault(_label(m[1]), m[2].strip("<>"))
            body = body[m.end() :]
        if body.strip():
            text = self.inline(body.strip())
            out.append(f"<h{level}>{text}</h{level}>" if level else text if tight else f"<p>{text}</p>")
        elif level:
            out.append(f"<p>{html.escape(lines[i - 1].strip())}</p>")  # an underline beneath definitions alone is text
        return i

    # ---- inlines

    def _target(self, text: str, at: int, label: str) -> tuple[str, int] | None:
        """(address, end) of what follows a bracket: an address in parentheses, a label, or nothing if the text is a label."""
        m = re.compile(r"""\(\s*(<[^<>\n]*>|(?:[^\s()\\]|\\.|\((?:[^\s()\\]|\\.)*\))*)(?:\s+(?:"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|\((?:[^()\\]|\\.)*\)))?\s*\)""").match(text, at)
        if m:
            return m[1].strip("<>"), m.end()
        m = re.compile(r"\[((?:[^\\\[\]]|\\.)*)\]").match(text, at)
        name, end = (m[1] or label, m.end()) if m else (label, at)
        found = self.links.get(_label(name))
        return None if found is None else (found, end)

    @staticmethod
    def _closing(text: str, at: int) -> int:
        """Where the bracket that opens at a place closes; -1 if nowhere. Code spans and escapes are passed over."""
        depth, i = 0, at
        while i < len(text):
            if text[i] == "\\":
                i += 2
                continue
            if text[i] == "`":
                run = re.compile("`+").match(text, i)
                end = re.compile(rf"(?<!`)`{{{len(run[0])}}}(?!`)").search(text, run.end())
                i = end.end() if end else run.end()
                continue
            depth += (text[i] == "[") - (text[i] == "]")
            if not depth:
                return i
            i += 1
        return -1

    def inline(self, text: str) -> str:
        nodes: list = []  # texts, and delimiter runs as [mark, length, opens, closes]
        i = 0
        while i < len(text):
            c = text[i]
            if c == "\\" and i + 1 < len(text) and (text[i + 1] in _PUNCT or text[i + 1] == "\n"):
                nodes.append("<br>" if text[i + 1] == "\n" else html.escape(text[i + 1], False))
                i += 2
            elif c == "`":
                run = re.compile("`+").match(text, i)
                end = re.compile(rf"(?<!`)`{{{len(run[0])}}}(?!`)").search(text, run.end())
                if end:
                    body = text[run.end() : end.start()].replace("\n", " ")
                    if body.strip(" ") and body[0] == body[-1] == " ":
                        body = body[1:-1]
                    nodes.append(html.escape(body, False))
                    i = end.end()
                else:
                    nodes.append(run[0])
                    i = run.end()
            elif c == "<" and (m := re.compile(r"<([A-Za-z][A-Za-z0-9+.-]{1,31}:[^\s<>]*|[\w.!#$%&'*+/=?^`{|}~-]+@[\w-]+(?:\.[\w-]+)*)>").match(text, i)):
                nodes.append(f'<a href="{html.escape(m[1])}">{html.escape(m[1], False)}</a>')
                i = m.end()
            elif c == "&" and (m := re.compile(r"&(?:#\d{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});").match(text, i)):
                nodes.append(html.escape(html.unescape(m[0]), False))
                i = m.end()
            elif c == "[" or c == "!" and text[i + 1 : i + 2] == "[":
                image = c == "!"
                end = self._closing(text, i + image)
                inner = text[i + image + 1 : end]
                found = self._target(text, end + 1, inner) if end >= 0 else None
                if found and image:
                    alt = html.unescape(re.sub(r"<img alt=\"([^\"]*)\"[^>]*>|<[^>]*>", r"\1", self.inline(inner)))
                    nodes.append(f'<img alt="{html.escape(alt)}" src="{html.escape(found[0])}">')
                    i = found[1]
                elif found:
                    nodes.append(f'<a href="{html.escape(found[0])}">{self.inline(inner)}</a>')
                    i = found[1]
                else:
                    nodes.append("![" if image else "[")
                    i += 1 + image
            elif c in "*_~":
                m = re.compile(rf"{re.escape(c)}+").match(text, i)
                nodes.append([c, len(m[0]), *_flanks(text, i, m.end())])
                i = m.end()
            elif c == " " and (m := re.compile(r" {2,}\n").match(text, i)):
                nodes.append("<br>")
                i = m.end()
            else:
                nodes.append(html.escape(c, False))
                i += 1
        return _matched(nodes)


def _label(text: str) -> str:
    return " ".join(text.split()).casefold()


def _flanks(text: str, begin: int, end: int) -> tuple[bool, bool]:
    """Whether a run of delimiters may open, and may close."""
    before, after = text[begin - 1] if begin else " ", text[end] if end < len(text) else " "
    mark = lambda c: c in _PUNCT or unicodedata.category(c)[0] in "PS"
    left = not after.isspace() and (not mark(after) or before.isspace() or mark(before))
    right = not before.isspace() and (not mark(before) or after.isspace() or mark(after))
    if text[begin] == "_":
        return left and (not right or mark(before)), right and (not left or mark(after))
    return left, right


def _matched(nodes: list) -> str:
    """The text with matched delimiters as elements; those that match nothing stay."""
    begins, ends = [""] * len(nodes), [""] * len(nodes)  # what stands behind an opener, and before a closer
    size = {k: n[1] for k, n in enumerate(nodes) if isinstance(n, list)}
    stack: list[int] = []
    for k, node in enumerate(nodes):
        if not isinstance(node, list):
            continue
        mark, length, opens, closes = node
        if closes:
            while size[k]:
                at = next((j for j in reversed(stack) if nodes[j][0] == mark and size[j] and not ((nodes[j][3] or opens) and (nodes[j][1] + length) % 3 == 0 and (nodes[j][1] % 3 or length % 3))), None)
                if at is None or mark == "~" and (size[at] < 2 or size[k] < 2):
                    break
                n = 2 if size[at] >= 2 and size[k] >= 2 else 1
                tag = "s" if mark == "~" else "strong" if n == 2 else "em"
                begins[at] = f"<{tag}>{begins[at]}"
                ends[k] += f"</{tag}>"
                size[at] -= n
                size[k] -= n
                stack = [j for j in stack if j <= at]
                if not size[at]:
                    stack.remove(at)
        if opens and size[k]:
            stack.append(k)
    return "".join(ends[k] + n[0] * size[k] + begins[k] if isinstance(n, list) else n for k, n in enumerate(nodes))


def to_html(text: str) -> str:
    """A document's HTML. References may be defined anywhere, so definitions are gathered first."""
    lines = [_expanded(x) for x in re.split(r"\r\n|\n|\r", (text or "").replace("\0", "�"))]
    reader = _Reader()
    reader.render(lines)
    return reader.render(lines)
