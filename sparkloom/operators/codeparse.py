"""Structure of source files: modules, classes, functions, and what they refer to, one file at a time.

Python is read by its own grammar. The other languages are scanned: a lexer blanks comments and literals, code in literals too; then declarations are
recognised at the brackets' depth where they can stand. Every parser gives facts as dictionaries with the keys of FACT:

* ``Module``, ``Class``, ``Function``, ``ModuleCall``: entities, ``qual`` being their name within the module;
* ``KEY``: another name under which the module is imported (namespace, package, folder);
* ``IMPORTS``: a module named in ``target``; several targets with one ``name`` are alternatives;
* ``FROM``: ``name`` stands for ``target`` of module ``module``; ``INHERITS`` and ``CALLS``: from ``qual`` to ``target``;
* ``RECEIVES``: function ``qual`` belongs to the type ``target``, declared anywhere in the same folder.
"""

from __future__ import annotations

import ast
import bisect
import posixpath
import re
from collections.abc import Iterator
from dataclasses import dataclass

FACT = {"kind": "string", "qual": "string", "name": "string", "line_start": "long", "line_end": "long", "signature": "string", "docstring": "string", "owner": "string", "is_method": "boolean", "target": "string", "module": "string", "version": "string"}

Fact = dict


def dotted(path: str) -> str:
    """The dotted name of a file below its root."""
    name = posixpath.splitext(path)[0].replace("/", ".")
    return name.removesuffix(".__init__") if path.endswith(".py") else name


# Python


def _header(node: ast.ClassDef | ast.FunctionDef | ast.AsyncFunctionDef) -> str:
    """The declaration without decorators and body, on one line."""
    fields = {name: getattr(node, name, None) for name in node._fields} | {"body": [ast.Pass()], "decorator_list": []}
    text = ast.unparse(ast.fix_missing_locations(type(node)(**fields)))
    return " ".join(text[: text.rindex("pass")].split())


class _Calls(ast.NodeVisitor):
    """Called bare names and methods of ``self``; definitions inside have calls of their own."""

    def __init__(self):
        self.found: dict[str, None] = {}

    def visit_FunctionDef(self, node):  # noqa: N802
        pass

    visit_AsyncFunctionDef = visit_ClassDef = visit_FunctionDef  # noqa: N815

    def visit_Call(self, node):  # noqa: N802
        match node.func:
            case ast.Name(id=name):
                self.found[name] = None
            case ast.Attribute(value=ast.Name(id="self"), attr=name):
                self.found[f"self.{name}"] = None
        self.generic_visit(node)


def parse_python(path: str, source: str, calls: bool = True) -> Iterator[Fact]:
    tree = ast.parse(source)
    module = dotted(path)
    yield {"kind": "Module", "name": module, "line_start": 1, "line_end": source.count("\n") + 1, "docstring": ast.get_docstring(tree) or ""}
    package = module.split(".")[: None if path.endswith("__init__.py") else -1]
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            for name in node.names:
                yield {"kind": "IMPORTS", "target": name.name}
        elif isinstance(node, ast.ImportFrom):
            up = package[: max(0, len(package) - node.level + 1)] if node.level else []
            base = ".".join([*up, *([node.module] if node.module else [])])
            if base:
                yield {"kind": "IMPORTS", "target": base}
            for name in node.names:
                yield {"kind": "FROM", "name": name.asname or name.name, "target": name.name, "module": base}
                if base:  # the name may be a module itself
                    yield {"kind": "IMPORTS", "target": f"{base}.{name.name}"}
    yield from _python_body(tree.body, None, calls)


def _python_body(body: list[ast.stmt], owner: str | None, calls: bool) -> Iterator[Fact]:
    for node in body:
        if not isinstance(node, (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)):
            continue
        qual = f"{owner}.{node.name}" if owner else node.name
        is_class = isinstance(node, ast.ClassDef)
        yield {"kind": "Class" if is_class else "Function", "qual": qual, "name": node.name, "line_start": node.lineno, "line_end": node.end_lineno, "signature": _header(node), "docstring": ast.get_docstring(node) or "", "owner": owner, "is_method": not is_class and owner is not None}
        if is_class:
            for base in node.bases:
                yield {"kind": "INHERITS", "qual": qual, "target": ast.unparse(base).partition("[")[0]}
            yield from _python_body(node.body, qual, calls)
        elif calls:
            visitor = _Calls()
            for statement in node.body:
                visitor.visit(statement)
            for name in visitor.found:
                yield {"kind": "CALLS", "qual": qual, "target": name, "owner": owner}


# scanned languages

@dataclass(frozen=True)
class Lexicon:
    """What is no code in a language. ``token`` finds comments (group ``comment``), plain literals (``text``), openings of literals with code in
    them (``open``), and braces; ``inside`` says, for an opening, what ends such a literal (``end``) and what begins code (``hole``)."""

    token: re.Pattern
    inside: dict[str, re.Pattern]
    slashes: bool = False


_COMMENTS = r"(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))"
_QUOTED = r'"(?:[^"\\\n]|\\.)*"'
_CHARACTERS = r"'(?:[^'\\\n]|\\.)*'"

SCRIPT = Lexicon(
    re.compile(rf"{_COMMENTS}|(?P<text>{_QUOTED}|{_CHARACTERS})|(?P<open>`)|(?P<word>[\w$]+)|(?P<mark>=>|\+\+|--|[^\s\w$])", re.S),
    {"`": re.compile(r"\\.|(?P<end>`)|(?P<hole>\$\{)", re.S)},
    slashes=True,
)
CSHARP = Lexicon(
    re.compile(rf"""{_COMMENTS}|\$*(?P<text>(?P<raw>"{{3,}})(?!").*?(?P=raw)(?!"))|@(?P<verbatim>"(?:[^"]|"")*")|(?P<open>\$@"|@\$"|\$")|(?P<plain>{_QUOTED}|{_CHARACTERS})|(?P<mark>[{{}}])""", re.S),
    {'$"': re.compile(r"""\\.|\{\{|(?P<end>")|(?P<hole>\{)""", re.S)} | dict.fromkeys(('$@"', '@$"'), re.compile(r"""\"\"|\{\{|(?P<end>")|(?P<hole>\{)""", re.S)),
)
GO = Lexicon(re.compile(rf"{_COMMENTS}|(?P<text>{_QUOTED}|{_CHARACTERS}|`[^`]*`)|(?P<mark>[{{}}])", re.S), {})
TERRAFORM = Lexicon(
    re.compile(r"""(?P<comment>(?://|\#)[^\n]*|/\*.*?(?:\*/|\Z))|(?P<text><<-?(?P<until>\w+)[ \t]*\n(?:.*?\n)??[ \t]*(?P=until)\b)|(?P<open>")|(?P<mark>[{}])""", re.S),
    {'"': re.compile(r"""\\.|\$\$\{|%%\{|(?P<end>")|(?P<hole>[$%]\{)""", re.S)},
)

_REGEX = re.compile(r"/(?![*/])(?:[^\\/\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/")
# Words of the language after which a slash begins a regular expression.
_BEFORE_VALUES = {"return", "typeof", "case", "in", "of", "delete", "void", "throw", "new", "instanceof", "do", "else", "yield", "await", "default"}
_BEFORE_CONDITIONS = {"if", "while", "for", "with"}


def literals(source: str, lexicon: Lexicon) -> Iterator[tuple[int, int, bool]]:
    """(start, end, whether it is a comment) of the comments and outermost literals, in order. A literal with code in it is one, however deep it goes."""
    held: list[tuple[re.Pattern, int]] = []  # open literals, and how many braces are open in their code
    start = at = 0
    value = False  # whether a value ends here, so that a slash divides
    conditions, last = [], ""  # of the open parentheses, whether a condition stands in them
    while m := lexicon.token.search(source, at):
        kind, at = m.lastgroup, m.end()
        if lexicon.slashes and kind == "mark" and m[0] == "/" and not value and (found := _REGEX.match(source, m.start())):
            kind, at = "text", found.end()
        if kind == "comment":
            if not held:
                yield m.start(), at, True
            continue
        if kind in ("text", "plain", "verbatim"):
            if not held:
                yield (m.start(kind) if lexicon is CSHARP else m.start()), at, False
            value = True
            continue
        closes = False
        if kind == "open":
            if not held:
                start = at - 1
            held.append((lexicon.inside[m[0]], -1))
        elif m[0] == "{" and held:
            held[-1] = (held[-1][0], held[-1][1] + 1)
        elif m[0] == "}" and held:
            closes = held[-1][1] == 0
            held[-1] = (held[-1][0], held[-1][1] - 1)
        if lexicon.slashes:
            if m[0] == "(":
                conditions.append(last in _BEFORE_CONDITIONS)
            if kind == "word":
                value = m[0] not in _BEFORE_VALUES or last == "."
            elif m[0] == ")":
                value = not (conditions and conditions.pop())
            elif m[0] == "!":  # after a value it asserts that the value is there
                value = value and source[m.start() - 1 : m.start()].strip() != ""
            else:
                # an angle before a slash is a tag's
                value = m[0] in ("]", "}", "++", "--", "<", ">")
            last = m[0]
        while held and (kind == "open" or closes):
            inside = held[-1][0]
            while (e := inside.search(source, at)) and e.lastgroup is None:
                at = e.end()
            if e is None:
                raise SyntaxError(f"a literal of line {source.count(chr(10), 0, start) + 1} is not closed")
            at = e.end()
            if e.lastgroup == "hole":
                held[-1] = (inside, 0)
                value, last = False, ""
            else:
                held.pop()
                value = True
                if not held:
                    yield start, at, False
            break


class Scan:
    """A source with comments and literals blanked out (``bare``, same length), and its lines and comments."""

    def __init__(self, source: str, lexicon: Lexicon):
        self.source, self.comments = source, []
        self.line_starts = [0, *(m.end() for m in re.finditer("\n", source))]
        parts, at = [], 0
        for start, end, comment in literals(source, lexicon):
            if comment:
                self.comments.append((start, end))
            edge = 0 if comment else 1
            parts += [source[at : start + edge], re.sub(r"[^\n]", " ", source[start + edge : end - edge])]
            at = end - edge
        self.bare = "".join(parts) + source[at:]
        self.closing = self._brackets()

    def _brackets(self) -> dict[int, int]:
        """Where each brace closes. Unbalanced braces are a syntax error."""
        out, stack = {}, []
        for m in re.finditer(r"[{}]", self.bare):
            if m[0] == "{":
                stack.append(m.start())
            elif not stack:
                raise SyntaxError(f"unexpected }} in line {self.line(m.start())}")
            else:
                out[stack.pop()] = m.start()
        if stack:
            raise SyntaxError(f"{{ of line {self.line(stack[-1])} is not closed")
        return out

    def line(self, at: int) -> int:
        return bisect.bisect_right(self.line_starts, at)

    def docstring(self, at: int) -> str:
        """The comments that end on the line before, and those before them without a gap."""
        line, parts = self.line(at), []
        for start, end in reversed(self.comments):
            if end > at:
                continue
            alone = not self.bare[self.line_starts[self.line(start) - 1] : start].strip()
            if not alone or self.line(end - 1) != line - 1:
                break
            parts.append(self.source[start:end])
            line = self.line(start)
        return "\n".join(filter(None, map(clean_comment, reversed(parts))))

    def text(self, start: int, end: int) -> str:
        return " ".join(self.source[start:end].split())


def clean_comment(comment: str) -> str:
    """A comment's words without its marks, the stars of its lines, and XML tags."""
    body = re.sub(r"^/\*+|\*+/$|^(?:///?|#)", "", comment.strip())
    lines = (re.sub(r"^\s*\*+ ?", "", line).strip() for line in body.split("\n"))
    return re.sub(r"</?[A-Za-z][^<>]*>", "", "\n".join(lines)).strip()


def statements(scan: Scan, start: int, end: int) -> Iterator[tuple[int, int, int | None]]:
    """(begin, end of header, where its body opens or None) of each statement between two places; bodies are not entered.

    Braces in parentheses, and those of types (after a colon, comma, bar or angle), belong to the header.
    """
    at = begin = start
    depth = 0
    while m := _STEPS.search(scan.bare, at, end):
        at = m.end()
        if m[0] in "([":
            depth += 1
        elif m[0] in ")]":
            depth = max(0, depth - 1)
        elif m[0] == "{" and (depth or scan.bare[begin : m.start()].rstrip()[-1:] in tuple(":,|&<")):
            at = scan.closing[m.start()] + 1
        elif m[0] == "{" or not depth:
            yield begin, m.start(), m.start() if m[0] == "{" else None
            at = begin = (scan.closing[m.start()] if m[0] == "{" else m.start()) + 1
    if scan.bare[begin:end].strip():
        yield begin, end, None


_STEPS = re.compile(r"[{;()\[\]]")


def outside(scan: Scan, begin: int, at: int) -> bool:
    """Whether a place stands in no bracket opened after another one."""
    part = scan.bare[begin:at]
    return all(part.count(x) == part.count(y) for x, y in ("()", "[]", "{}"))


def _first(scan: Scan, begin: int) -> int:
    m = re.compile(r"\S").search(scan.bare, begin)
    return m.start() if m else begin


def _entity(scan: Scan, kind: str, qual: str, begin: int, head_end: int, body: int | None, owner: str | None, shown: int | None = None) -> Fact:
    """``begin``: where the declaration begins with its modifiers; ``shown``: where its signature does."""
    end = scan.closing[body] if body is not None else head_end
    return {
        "kind": kind, "qual": qual, "name": qual.rpartition(".")[2], "line_start": scan.line(begin), "line_end": scan.line(end),
        "signature": scan.text(begin if shown is None else shown, head_end), "docstring": scan.docstring(begin), "owner": owner, "is_method": kind == "Function" and owner is not None,
    }


def _module(source: str, path: str) -> Fact:
    return {"kind": "Module", "name": dotted(path), "line_start": 1, "line_end": source.count("\n") + 1, "docstring": ""}


# type parameters, nested up to three deep
_ANGLES = r"<(?:[^<>;]|=>|<(?:[^<>;]|=>|<(?:[^<>;]|=>)*>)*>)*>"
_TS_LEAD = r"(?:^|(?<=[{};]))[ \t]*(?:@[\w.]+(?:\([^)]*\))?\s*)*(?:export\s+)?(?:default\s+)?(?:declare\s+)?"
_TS_TYPE = re.compile(_TS_LEAD + r"(?P<shown>(?:abstract\s+)?(?:class|interface|enum)\s+(?P<name>[A-Za-z_$][\w$]*))", re.M)
_TS_SPACE = re.compile(_TS_LEAD + r"(?:namespace|module)\s+(?P<name>[A-Za-z_$][\w$.]*)", re.M)
_TS_FUNCTION = re.compile(_TS_LEAD + r"(?P<shown>(?:async\s+)?function\s*\*?\s*(?P<name>[A-Za-z_$][\w$]*))", re.M)
_TS_ARROW = re.compile(_TS_LEAD + r"(?P<shown>(?:const|let|var)\s+(?P<name>[A-Za-z_$][\w$]*)(?:[^=\n]|=>)*=(?![=>])\s*(?:async\s+)?(?:function\b|(?:" + _ANGLES + r"\s*)?\([^()]*(?:\([^()]*\)[^()]*)*\)[^=;]*=>|[A-Za-z_$][\w$]*\s*=>))", re.M)
_TS_METHOD = re.compile(r"(?:^|(?<=[{};]))[ \t]*(?:@[\w.]+(?:\([^)]*\))?\s*)*(?P<shown>(?:(?:public|private|protected|static|readonly|override|abstract|async|get|set)\s+)*\*?(?P<name>[A-Za-z_$#][\w$]*)\??\s*(?:" + _ANGLES + r")?\()", re.M)
_TS_IMPORT = re.compile(r"""(?:\bfrom\s*|\bimport\s*\(?\s*|\brequire\s*\(\s*)(["'])(?P<path>[^"'\n]+)\1""")
_NOT_NAMES = {"if", "for", "while", "switch", "catch", "return", "new", "function", "super", "await", "typeof", "using", "lock", "fixed", "foreach", "else", "do", "throw", "base", "this", "when", "nameof"}


def relative_modules(path: str, target: str) -> list[str]:
    """Dotted names that a relative import can mean: the file itself, or the index of a folder."""
    where = posixpath.normpath(posixpath.join(posixpath.dirname(path), target))
    if where.startswith(".."):
        return []
    name = re.sub(r"\.(?:tsx?|jsx?|mjs|cjs)$", "", where).replace("/", ".").strip(".")
    return [name, f"{name}.index"] if name else ["index"]


def parse_script(path: str, source: str, calls: bool = True) -> Iterator[Fact]:
    """TypeScript and JavaScript."""
    scan = Scan(source, SCRIPT)
    yield _module(source, path)
    seen: dict[str, None] = {}
    for m in _TS_IMPORT.finditer(source):
        # the keyword must be code; what it names is a literal
        if scan.bare[m.start()] != " " and m["path"].startswith("."):
            seen[m["path"]] = None
    for target in seen:
        for name in relative_modules(path, target):
            yield {"kind": "IMPORTS", "target": name, "name": target}
    yield from _script_body(scan, 0, len(source), None, "")


def _last(pattern: re.Pattern, scan: Scan, begin: int, end: int) -> re.Match | None:
    """The last match in a header: lines without semicolons before it belong to other statements."""
    found = None
    for m in pattern.finditer(scan.bare, begin, end):
        if outside(scan, begin, m.start("shown" if "shown" in pattern.groupindex else "name")):
            found = m
    return found


def _script_body(scan: Scan, start: int, end: int, owner: str | None, prefix: str) -> Iterator[Fact]:
    for begin, head_end, body in statements(scan, start, end):
        if m := _last(_TS_SPACE, scan, begin, head_end):
            if body is not None:
                yield from _script_body(scan, body + 1, scan.closing[body], None, f"{prefix}{m['name']}.")
        elif body is not None and (m := _last(_TS_TYPE, scan, begin, head_end)):
            qual = prefix + m["name"]
            yield _entity(scan, "Class", qual, _first(scan, m.start()), head_end, body, None, m.start("shown"))
            if not m["shown"].startswith("enum"):
                yield from _script_members(scan, body + 1, scan.closing[body], qual)
        else:
            # without semicolons a header may hold several declarations; the last has the body
            found = sorted([m for p in (_TS_ARROW, _TS_FUNCTION) for m in p.finditer(scan.bare, begin, head_end) if outside(scan, begin, m.start("shown"))], key=lambda m: m.start("name"))
            for k, m in enumerate(found):
                last = k + 1 == len(found)
                end_of = head_end if last else _last_mark(scan, found[k + 1].start())
                yield _entity(scan, "Function", prefix + m["name"], _first(scan, m.start()), end_of, body if last else None, None, m.start("shown"))


def _last_mark(scan: Scan, at: int) -> int:
    """Where what stands before a place ends, blanks apart."""
    return len(scan.bare[:at].rstrip())


def _script_members(scan: Scan, start: int, end: int, owner: str) -> Iterator[Fact]:
    for begin, head_end, body in statements(scan, start, end):
        m = _last(_TS_METHOD, scan, begin, head_end)
        if m and m["name"] not in _NOT_NAMES and "=" not in scan.bare[m.start() : m.end()]:
            yield _entity(scan, "Function", f"{owner}.{m['name']}", _first(scan, m.start()), head_end, body, owner, m.start("shown"))


_CS_TYPE = re.compile(r"(?:\[[^\]]*\]\s*)*(?P<shown>(?:(?:public|private|protected|internal|static|abstract|sealed|partial|readonly|ref|unsafe|new|file)\s+)*(?:class|interface|struct|enum|record(?:\s+(?:class|struct))?)\s+(?P<name>[A-Za-z_]\w*))")
_CS_METHOD = re.compile(r"(?:\[[^\]]*\]\s*)*(?P<shown>(?:[A-Za-z_][\w.<>,\[\]?]*(?:\s*<[^;{}()]*>)?\s+)*(?P<name>[A-Za-z_]\w*)\s*(?:<[^()]*>)?\s*\()")


def parse_csharp(path: str, source: str, calls: bool = True) -> Iterator[Fact]:
    scan = Scan(source, CSHARP)
    yield _module(source, path)
    for m in re.finditer(r"^[ \t]*(?:global\s+)?using\s+(?:static\s+)?(?:[A-Za-z_]\w*\s*=\s*)?([A-Za-z_][\w.]*)\s*;", scan.bare, re.M):
        yield {"kind": "IMPORTS", "target": m[1]}
    for name in dict.fromkeys(re.findall(r"\bnamespace\s+([A-Za-z_][\w.]*)", scan.bare)):
        yield {"kind": "KEY", "target": name}
    yield from _csharp_body(scan, 0, len(source), None, "")


def _csharp_body(scan: Scan, start: int, end: int, owner: str | None, prefix: str) -> Iterator[Fact]:
    for begin, head_end, body in statements(scan, start, end):
        begin = _first(scan, begin)
        head = scan.bare[begin:head_end]
        if m := re.match(r"namespace\s+([A-Za-z_][\w.]*)", head):
            if body is None:  # it holds for the rest of the file
                prefix = f"{m[1]}."
            else:
                yield from _csharp_body(scan, body + 1, scan.closing[body], None, f"{prefix}{m[1]}.")
        elif m := _CS_TYPE.match(scan.bare, begin, head_end):
            qual = prefix + m["name"]
            yield _entity(scan, "Class", qual, begin, head_end, body, None, m.start("shown"))
            if body is not None and " enum " not in f" {m['shown']} ":
                yield from _csharp_body(scan, body + 1, scan.closing[body], qual, f"{qual}.")
        elif owner and (m := _CS_METHOD.match(scan.bare, begin, head_end)) and m["name"] not in _NOT_NAMES and "=" not in scan.bare[begin : m.end()]:
            yield _entity(scan, "Function", f"{owner}.{m['name']}", begin, head_end, body, owner, m.start("shown"))


_GO_TOP = re.compile(r"^(?:func[ \t]*(?:\((?P<receiver>[^)]*)\)[ \t]*)?(?P<func>[A-Za-z_]\w*)|type[ \t]+(?P<type>[A-Za-z_]\w*)|type[ \t]*(?P<group>\())", re.M)


def parse_go(path: str, source: str, calls: bool = True) -> Iterator[Fact]:
    scan = Scan(source, GO)
    yield _module(source, path)
    if m := re.search(r"^package[ \t]+(\w+)", scan.bare, re.M):
        yield {"kind": "KEY", "target": m[1]}
    imports = [source[m.start(1) : m.end(1)] for m in re.finditer(r'^import[ \t]+(?:[\w.]+[ \t]+)?"([^"\n]*)"', scan.bare, re.M)]
    for block in re.finditer(r"^import[ \t]*\(([^)]*)\)", scan.bare, re.M):
        imports += [source[block.start(1) + m.start(1) : block.start(1) + m.end(1)] for m in re.finditer(r'"([^"\n]*)"', block[1])]
    for target in dict.fromkeys(imports):
        yield {"kind": "IMPORTS", "target": target.rstrip("/").rpartition("/")[2]}
    for m in _GO_TOP.finditer(scan.bare):
        if m["group"]:
            close = scan.bare.find("\n)", m.end())
            for one in re.compile(r"^[ \t]+(?P<type>[A-Za-z_]\w*)(?=[ \t\[])", re.M).finditer(scan.bare, m.end(), len(source) if close < 0 else close):
                if _depth_is_level(scan, m.end(), one.start()):
                    yield from _go_type(scan, one.start("type"), one)
        elif m["type"]:
            yield from _go_type(scan, m.start(), m)
        else:
            head_end, body = _go_header(scan, m.end())
            owner = re.search(r"([A-Za-z_]\w*)(?:\[[^\]]*\])?\s*$", m["receiver"] or "")
            qual = f"{owner[1]}.{m['func']}" if owner else m["func"]
            yield _entity(scan, "Function", qual, m.start(), head_end, body, None) | {"is_method": owner is not None, "owner": f"?{owner[1]}" if owner else None}
            if owner:
                yield {"kind": "RECEIVES", "qual": qual, "target": owner[1]}


def _depth_is_level(scan: Scan, start: int, at: int) -> bool:
    return scan.bare.count("{", start, at) == scan.bare.count("}", start, at)


def _go_header(scan: Scan, at: int) -> tuple[int, int | None]:
    """The end of a declaration's head, and where its body opens: at a brace outside parentheses, or at the line's end."""
    depth = 0
    for m in re.compile(r"[(){\n]").finditer(scan.bare, at):
        if m[0] in "()":
            depth += 1 if m[0] == "(" else -1
        elif depth <= 0 and m[0] == "{":
            if scan.bare[scan.closing[m.start()] + 1 : scan.closing[m.start()] + 3].strip().startswith("{"):
                continue  # an unnamed struct or interface among the results
            return m.start(), m.start()
        elif depth <= 0 and m[0] == "\n":
            return m.start(), None
    return len(scan.bare), None


def _go_type(scan: Scan, begin: int, m: re.Match) -> Iterator[Fact]:
    head_end, body = _go_header(scan, m.end())
    yield _entity(scan, "Class", m["type"], begin, head_end, body, None)
    if body is not None and re.search(r"\binterface\s*$", scan.bare[m.end() : body]):
        for one in re.compile(r"^[ \t]*(?P<name>[A-Za-z_]\w*)[ \t]*\(", re.M).finditer(scan.bare, body + 1, scan.closing[body]):
            line_end = scan.bare.find("\n", one.end())
            yield _entity(scan, "Function", f"{m['type']}.{one['name']}", one.start("name"), line_end if 0 <= line_end < scan.closing[body] else scan.closing[body], None, m["type"])


def parse_terraform(path: str, source: str, calls: bool = True) -> Iterator[Fact]:
    scan = Scan(source, TERRAFORM)
    yield _module(source, path)
    folder = posixpath.dirname(path)
    if folder:
        yield {"kind": "KEY", "target": folder.replace("/", ".")}
    for m in re.finditer(r'^[ \t]*module[ \t]+"([^"\n]*)"[ \t]*\{', scan.bare, re.M):
        name, open_ = source[m.start(1) : m.end(1)], m.end() - 1
        values = {}
        for v in re.compile(r'^[ \t]*(source|version)[ \t]*=[ \t]*"([^"\n]*)"', re.M).finditer(scan.bare, open_ + 1, scan.closing[open_]):
            if _depth_is_level(scan, open_ + 1, v.start()):
                values.setdefault(v[1], source[v.start(2) : v.end(2)])
        yield {"kind": "ModuleCall", "qual": name, "name": name, "line_start": scan.line(_first(scan, m.start())), "line_end": scan.line(scan.closing[open_]), "target": values.get("source"), "version": values.get("version")}
        if values.get("source", "").startswith("."):
            where = posixpath.normpath(posixpath.join(folder, values["source"]))
            if not where.startswith("..") and where != ".":
                yield {"kind": "IMPORTS", "target": where.replace("/", ".")}


#: Suffix to language and parser; more can be added.
PARSERS = {
    ".py": ("python", parse_python),
    **{s: ("typescript", parse_script) for s in (".ts", ".tsx")},
    **{s: ("javascript", parse_script) for s in (".js", ".jsx", ".mjs", ".cjs")},
    ".cs": ("csharp", parse_csharp),
    ".tf": ("hcl", parse_terraform),
    ".go": ("go", parse_go),
}
# Suffixes of code that no parser reads; they are counted in a warning.
UNREAD_SUFFIXES = (".c", ".cc", ".cpp", ".cxx", ".h", ".hpp", ".java", ".kt", ".kts", ".lua", ".m", ".php", ".pl", ".rb", ".rs", ".scala", ".sh", ".sql", ".swift", ".vue")


def parse_file(path: str, source: str, calls: bool = True) -> list[Fact]:
    """The facts of one file; one of kind ``Error`` if it cannot be parsed, none for an unknown suffix."""
    language, parser = PARSERS.get(posixpath.splitext(path)[1].lower(), (None, None))
    if parser is None:
        return []
    try:
        return [fact | {"version": fact.get("version") or (language if fact["kind"] == "Module" else None)} for fact in parser(path, source, calls)]
    except (SyntaxError, ValueError, RecursionError) as why:
        return [{"kind": "Error", "name": str(why)}]
