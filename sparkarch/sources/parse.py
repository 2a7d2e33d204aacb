"""Facts of Python source files: one parse per file, one row per fact.

Pure functions of a path and its bytes. :mod:`sparkarch.sources.repository` runs them over files in parallel.
"""

from __future__ import annotations

import ast
import copy
import hashlib
import io
import re
import tokenize
from collections.abc import Callable, Iterator

Fact = tuple[str, str, int, dict[str, str | None]]

#: Method names that bind events, and keyword arguments that pass callbacks. Fixed values.
EVENT_METHODS = ("bind", "subscribe", "on")
CALLBACK_ARGUMENTS = ("command", "callback", "handler", "func", "on_click", "on_change", "on_submit")
_SECTION = re.compile(r"^\s*#\s*={3,}\s*(.+?)\s*={3,}\s*$|^\s*#\s*={3,}\s*$")
#: Names that do input or output, called plainly or as a method; windows' names and modules. Fixed values.
IO_CALLS = ("print", "open", "read", "write", "send", "recv", "input")
UI_CALLS, UI_MODULES = ("Tk", "Toplevel", "StringVar"), ("tk", "ttk")
#: Calls that name a symbol in a string, calls that take one to be written out, and decorators by what they expose to. Fixed values.
REFLECTION = ("getattr", "hasattr", "setattr", "import_module")
SERIALIZATION = ("dumps", "dump", "asdict")
DECORATORS = {"cli_exposure": ("command", "group", "cli"), "api_exposure": ("get", "post", "route", "api", "app"), "registry": ("register", "register_handler", "subscribe", "receiver")}


def decode(content: bytes) -> str:
    """Text of a source file by its byte order mark or coding line, UTF-8 otherwise; may raise SyntaxError or UnicodeDecodeError."""
    encoding, _ = tokenize.detect_encoding(io.BytesIO(content).readline)
    return content.decode(encoding)


def read(content: bytes) -> tuple[str | None, ast.Module | None, str | None, int | None, int | None]:
    """Text, tree, and for a file that can't be parsed the reason with line and column."""
    try:
        text = decode(content)
    except (SyntaxError, UnicodeDecodeError, LookupError) as e:
        return None, None, f"decode error: {e}", None, None
    if "\x00" in text:
        return text, None, "null bytes", None, None
    try:
        return text, ast.parse(text), None, None, None
    except SyntaxError as e:
        return text, None, f"syntax error: {e.msg}", e.lineno, e.offset
    except (RecursionError, MemoryError, ValueError) as e:
        return text, None, f"{type(e).__name__}: {e}", None, None


def signature(node: ast.FunctionDef | ast.AsyncFunctionDef) -> str:
    """Arguments with annotations and defaults, and what is returned."""
    a = node.args
    if not (a.posonlyargs or a.vararg or a.kwonlyargs or a.kwarg or node.returns) and all(x.annotation is None for x in a.args) and all(d.__class__ is ast.Constant and d.value.__class__ in _PLAIN for d in a.defaults):
        first = len(a.args) - len(a.defaults)  # the usual ones need no general writer
        return f"({', '.join(x.arg if i < first else f'{x.arg}={a.defaults[i - first].value!r}' for i, x in enumerate(a.args))})"
    back = f" -> {ast.unparse(node.returns)}" if node.returns else ""
    return f"({ast.unparse(node.args)}){back}"


#: Types of constants whose code is their repr.
_PLAIN = (int, bool, type(None))
#: Fields that hold neither nodes nor lists of them.
_FLAT_FIELDS = frozenset(("ctx", "op", "ops", "id", "attr", "arg", "type_comment", "kind", "level", "simple", "conversion", "is_async", "module", "asname"))
_FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)
#: What adds a path through a function, and a level of nesting.
_BRANCHES = (ast.If, ast.For, ast.While, ast.ExceptHandler)
_LEAVES = (ast.Name, ast.Constant)
_fields: dict[type, tuple[str, ...]] = dict.fromkeys(_LEAVES, ())


class _Flat:
    """A tree's nodes in the order of a depth-first walk; those below node ``i`` are the ones from ``i + 1`` to ``ends[i]``.

    ``depths``: functions around a node. ``typed``: whether it only runs for type checkers. ``branches``: branches down to it.
    ``functions``: qualified name, node and place of each. All facts of a file are read from one such walk.
    """

    def __init__(self, tree: ast.AST) -> None:
        self.nodes, self.ends, self.depths, self.typed, self.branches, self.functions = [], [], [], [], [], []
        nodes, ends, depths, typed, branches, functions = self.nodes, self.ends, self.depths, self.typed, self.branches, self.functions

        def visit(node: ast.AST, depth: int, hint: bool, branch: int, prefix: str) -> None:
            kind, i = node.__class__, len(nodes)
            nodes.append(node)
            depths.append(depth)
            typed.append(hint)
            ends.append(i + 1)
            if kind in _LEAVES:
                branches.append(branch)
                return
            branch += kind in _BRANCHES
            branches.append(branch)
            checked = False
            if kind in _FUNCTIONS:
                functions.append((prefix + node.name, node, i))
                prefix, depth = f"{prefix}{node.name}.", depth + 1
            elif kind is ast.ClassDef:
                prefix = f"{prefix}{node.name}."
            elif kind is ast.Lambda:
                depth += 1
            elif kind is ast.If:
                checked = _is_type_checking(node.test)
            names = _fields.get(kind)
            if names is None:
                names = _fields[kind] = tuple(f for f in kind._fields if f not in _FLAT_FIELDS)
            for name in names:
                value = getattr(node, name, None)
                if value.__class__ is list:
                    inner = hint or (checked and name == "body")
                    for c in value:
                        if isinstance(c, ast.AST):
                            visit(c, depth, inner, branch, prefix)
                elif isinstance(value, ast.AST):
                    visit(value, depth, hint, branch, prefix)
            ends[i] = len(nodes)

        visit(tree, 0, False, 0, "")
        del visit  # a function that holds itself would keep the nodes until a collection


def _flat(tree: ast.AST) -> _Flat:
    """The walk of a tree, kept beside it."""
    found = tree.__dict__.get("_walked")
    if found is None:
        found = tree._walked = _Flat(tree)
    return found


def _dump(node: object, memo: dict[int, str]) -> str:
    """What ``ast.dump`` gives, of nodes from a parse; that of definitions is kept in ``memo``."""
    kind = node.__class__
    if kind is ast.Name:
        return f"Name(id={node.id!r}, ctx={node.ctx.__class__.__name__}())"
    if kind is ast.Constant:
        return f"Constant(value={node.value!r})" if node.kind is None else f"Constant(value={node.value!r}, kind={node.kind!r})"
    if kind is list:
        return f"[{', '.join([_dump(x, memo) for x in node])}]"
    if not isinstance(node, ast.AST):
        return repr(node)
    named = kind in _FUNCTIONS
    if named and id(node) in memo:
        return memo[id(node)]
    parts = []
    for name in kind._fields:
        value = getattr(node, name, None)
        if value == [] or (value is None and kind is not ast.MatchSingleton):
            continue
        parts.append(f"{name}={value!r}" if value.__class__ is str else f"{name}={_dump(value, memo)}")
    out = f"{kind.__name__}({', '.join(parts)})"
    if named:
        memo[id(node)] = out
    return out


def fingerprint(node: ast.AST, memo: dict[int, str] | None = None) -> str:
    """Hash of a definition's tree without its docstring and places: formatting and comments don't change it.

    ``memo`` keeps what was written of the functions of one tree.
    """
    body = getattr(node, "body", [])
    if body and isinstance(body[0], ast.Expr) and isinstance(body[0].value, ast.Constant) and isinstance(body[0].value.value, str):
        node = copy.copy(node)
        node.body = body[1:]
        memo = None
    return hashlib.sha256(_dump(node, {} if memo is None else memo).encode()).hexdigest()[:16]


def dotted(node: ast.AST) -> str | None:
    """``a.b.c`` of a chain of attributes on a name."""
    parts = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    if not isinstance(node, ast.Name):
        return None
    return ".".join([node.id, *reversed(parts)])


def _is_type_checking(test: ast.AST) -> bool:
    return dotted(test) in ("TYPE_CHECKING", "typing.TYPE_CHECKING")


#: Fields of statements that hold statements, in the order in which a walk meets them.
_BLOCKS = ("body", "handlers", "orelse", "finalbody", "cases")


def _import_statements(block: list[ast.AST], local: bool = False, typed: bool = False) -> Iterator[tuple[ast.Import | ast.ImportFrom, bool, bool]]:
    """Import statements, whether in a function and whether for type checkers only; expressions, which hold none, aren't walked."""
    for node in block:
        kind = node.__class__
        if kind is ast.Import or kind is ast.ImportFrom:
            yield node, local, typed
            continue
        checked = kind is ast.If and _is_type_checking(node.test)
        inside = local or kind in _FUNCTIONS
        for name in _BLOCKS:
            if inner := getattr(node, name, None):
                yield from _import_statements(inner, inside, typed or (checked and name == "body"))


def imports(tree: ast.Module) -> Iterator[dict]:
    """A row per import statement and, for plain imports, per module."""
    pos = 0
    for node, local, typed in _import_statements(tree.body):
        if node.__class__ is ast.Import:
            for a in node.names:
                yield {"pos": pos, "module": a.name, "level": 0, "names": [], "is_from_import": False, "is_local": local, "type_only": typed}
                pos += 1
        else:
            yield {"pos": pos, "module": node.module, "level": node.level, "names": [a.name for a in node.names], "is_from_import": True, "is_local": local, "type_only": typed}
            pos += 1


def aliases(tree: ast.Module) -> Iterator[tuple[str, str]]:
    """Local name and what it stands for, of imports at any depth and of ``x = y`` at the top."""
    for node in _flat(tree).nodes:
        if node.__class__ is ast.Import:
            yield from ((a.asname or a.name.split(".")[0], a.name if a.asname else a.name.split(".")[0]) for a in node.names)
        elif node.__class__ is ast.ImportFrom and node.module:
            yield from ((a.asname or a.name, f"{'.' * node.level}{node.module}.{a.name}") for a in node.names if a.name != "*")
    for node in tree.body:
        if isinstance(node, ast.Assign) and len(node.targets) == 1 and isinstance(node.targets[0], ast.Name) and (name := dotted(node.value)):
            yield node.targets[0].id, name


def symbols(tree: ast.Module) -> Iterator[dict]:
    """Top-level classes, functions and names, and the classes' methods; definitions inside functions are left out."""
    memo: dict[int, str] = {}
    for node in tree.body:
        if isinstance(node, ast.ClassDef):
            yield {"symbol": node.name, "kind": "class", "signature": None, "body_fp": fingerprint(node, memo), "line": node.lineno}
            for m in node.body:
                if isinstance(m, (ast.FunctionDef, ast.AsyncFunctionDef)):
                    yield {"symbol": f"{node.name}.{m.name}", "kind": "method", "signature": signature(m), "body_fp": fingerprint(m, memo), "line": m.lineno}
        elif isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            yield {"symbol": node.name, "kind": "function", "signature": signature(node), "body_fp": fingerprint(node, memo), "line": node.lineno}
        else:
            yield from ({"symbol": n, "kind": "global", "signature": None, "body_fp": None, "line": node.lineno} for n in _bound(node))


def _bound(node: ast.stmt) -> Iterator[str]:
    """Names that a top-level statement assigns."""
    targets = node.targets if isinstance(node, ast.Assign) else [node.target] if isinstance(node, (ast.AnnAssign, ast.AugAssign)) else []
    for t in targets:
        for x in t.elts if isinstance(t, (ast.Tuple, ast.List)) else [t]:
            if isinstance(x, ast.Name):
                yield x.id


def _segments(text: str) -> Callable[[ast.AST], str]:
    """What gives the code of a node of the text's tree; the text is cut into lines once."""
    rows = [x.encode() for x in re.findall(r"[^\r\n]*(?:\r\n|\r|\n)|[^\r\n]+$", text)]

    def segment(node: ast.AST) -> str:
        held = rows[node.lineno - 1 : node.end_lineno]
        if not held:
            return ""
        held[-1] = held[-1][: node.end_col_offset]
        held[0] = held[0][node.col_offset :]
        return b"".join(held).decode()

    return segment


def collision_facts(tree: ast.Module, text: str) -> Iterator[dict]:
    """Public top-level classes, functions and constants with their code and place."""
    segment = _segments(text)
    for node in tree.body:
        if isinstance(node, (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)):
            found = [(node.name, "class" if isinstance(node, ast.ClassDef) else "function")]
        elif isinstance(node, ast.Assign):
            found = [(t.id, "variable") for t in node.targets if isinstance(t, ast.Name) and t.id.isupper()]
        elif isinstance(node, ast.AnnAssign) and isinstance(node.target, ast.Name) and node.target.id.isupper():
            found = [(node.target.id, "variable")]
        else:
            continue
        for name, kind in found:
            if not name.startswith("_"):
                yield {"name": name, "type": kind, "code": segment(node), "line_start": node.lineno, "line_end": node.end_lineno, "col_start": node.col_offset, "col_end": node.end_col_offset}


def usage_facts(tree: ast.Module) -> Iterator[tuple[str, str, str | None]]:
    """Channel, name and extra of what a module uses: calls, attribute references, callbacks, event bindings, bases, imports, aliases."""
    for name, target in aliases(tree):
        yield "aliases", name, target
    for row in imports(tree):
        base = "." * row["level"] + (row["module"] or "")
        if row["is_from_import"]:
            yield from (("imports", f"{base}.{n}" if base.strip(".") else f"{base}{n}", None) for n in row["names"])
        else:
            yield "imports", base, None
    called, nodes = set(), _flat(tree).nodes
    for node in nodes:
        if node.__class__ is ast.Call:
            called.add(id(node.func))
            name = dotted(node.func)
            if name:
                yield "direct_calls", name, None
                if name in ("getattr", "importlib.import_module", "__import__") and node.args and isinstance(node.args[-1], ast.Constant) and isinstance(node.args[-1].value, str):
                    yield "runtime_calls", node.args[-1].value, name
            for k in node.keywords:
                if k.arg in CALLBACK_ARGUMENTS and (target := dotted(k.value)):
                    yield "callback_calls", target, k.arg
            if isinstance(node.func, ast.Attribute) and node.func.attr in EVENT_METHODS:
                yield from (("event_bindings", target, node.func.attr) for a in node.args if (target := dotted(a)))
        elif node.__class__ is ast.ClassDef:
            yield from (("inheritance", base, node.name) for b in node.bases if (base := dotted(b)))
    for node in nodes:
        if node.__class__ is ast.Attribute and id(node) not in called and isinstance(node.ctx, ast.Load) and (name := dotted(node)):
            yield "qualified_refs", name, None


def exports(tree: ast.Module) -> Iterator[tuple[str, bool]]:
    """Exported names and whether ``__all__`` lists them; without it, top-level names that don't begin with an underscore."""
    listed = None
    for node in tree.body:
        if isinstance(node, ast.Assign) and any(isinstance(t, ast.Name) and t.id == "__all__" for t in node.targets) and isinstance(node.value, (ast.List, ast.Tuple)):
            listed = [e.value for e in node.value.elts if isinstance(e, ast.Constant) and isinstance(e.value, str)]
    if listed is not None:
        yield from ((n, True) for n in listed)
        return
    seen = dict.fromkeys(n for node in tree.body for n in ([node.name] if isinstance(node, (ast.ClassDef, *_FUNCTIONS)) else _bound(node)))
    yield from ((n, False) for n in seen if not n.startswith("_"))


def import_usage(tree: ast.Module, text: str) -> Iterator[tuple[str, int, int]]:
    """Imported local names with how often they are read at run time and for type checking."""
    walk = _flat(tree)
    names = {a: [0, 0] for n in walk.nodes if n.__class__ in (ast.Import, ast.ImportFrom) for a in (x.asname or x.name.split(".")[0] for x in n.names)}
    hints = set()
    for node in walk.nodes:
        if node.__class__ in _LEAVES:
            continue
        for f in ("annotation", "returns"):
            if (h := getattr(node, f, None)) is not None:
                hints.update(id(x) for x in ast.walk(h))
    for node, typed in zip(walk.nodes, walk.typed, strict=True):
        if node.__class__ is ast.Name and node.id in names and node.ctx.__class__ is ast.Load:
            names[node.id][typed or id(node) in hints] += 1
    yield from ((n, a, b) for n, (a, b) in names.items())


def api_surface(tree: ast.Module) -> Iterator[dict]:
    """Top-level classes and functions and the methods: visibility, bases, decorators, parameters, first line of the docstring, lines."""

    def row(node, qualifier: str = "") -> dict:
        is_class = isinstance(node, ast.ClassDef)
        args = [] if is_class else [a.arg for a in (*node.args.posonlyargs, *node.args.args, *node.args.kwonlyargs)]
        doc = (ast.get_docstring(node) or "").strip().split("\n")[0] or None
        return {"name": qualifier + node.name, "kind": "class" if is_class else "method" if qualifier else "function", "visibility": "private" if node.name.startswith("_") else "public", "bases": [dotted(b) or ast.unparse(b) for b in node.bases] if is_class else [], "decorators": [dotted(d) or ast.unparse(d) for d in node.decorator_list], "parameters": args, "doc": doc, "line_start": node.lineno, "line_end": node.end_lineno}

    for node in tree.body:
        if isinstance(node, (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)):
            yield row(node)
            if isinstance(node, ast.ClassDef):
                yield from (row(m, f"{node.name}.") for m in node.body if isinstance(m, (ast.FunctionDef, ast.AsyncFunctionDef)))


def function_metrics(tree: ast.Module) -> Iterator[dict]:
    """Cyclomatic complexity, deepest nesting, exceptions raised and caught by name, positional parameters never read, keys of returned dictionaries.

    Branches, loops, handlers and each further operand of and/or count; what is inside a nested function counts for both.
    """
    last = lambda n: n.id if isinstance(n, ast.Name) else n.attr if isinstance(n, ast.Attribute) else None
    walk = _flat(tree)
    for name, f, i in walk.functions:
        complexity, thrown, caught, read_names, keys = 1, set(), set(), set(), set()
        for n in walk.nodes[i : walk.ends[i]]:
            kind = n.__class__
            if kind is ast.Name:
                if n.ctx.__class__ is ast.Load:
                    read_names.add(n.id)
            elif kind in _BRANCHES:
                complexity += 1
                if kind is ast.ExceptHandler:
                    caught.add(last(n.type))
            elif kind is ast.BoolOp:
                complexity += len(n.values) - 1
            elif kind is ast.Raise:
                exc = n.exc.func if isinstance(n.exc, ast.Call) else n.exc
                if isinstance(exc, ast.Name):
                    thrown.add(exc.id)
            elif kind is ast.Return and isinstance(n.value, ast.Dict):
                keys.update(str(k.value) for k in n.value.keys if isinstance(k, ast.Constant))
        nesting = max(walk.branches[i : walk.ends[i]]) - walk.branches[i]
        yield {"name": name, "line": f.lineno, "complexity": complexity, "nesting": nesting, "raises": sorted(thrown), "catches": sorted(filter(None, caught)), "unused": sorted({a.arg for a in f.args.args} - read_names), "returned_keys": sorted(keys)}


def _does_io(call: ast.Call) -> bool:
    f = call.func
    if isinstance(f, ast.Name):
        return f.id in IO_CALLS or f.id in UI_CALLS
    return isinstance(f, ast.Attribute) and (f.attr in IO_CALLS or (isinstance(f.value, ast.Name) and (f.attr == "set" or f.value.id in UI_MODULES)))


def function_state(tree: ast.Module) -> Iterator[dict]:
    """What a function changes, what functions nested in it take from it, whether it does I/O, and whether it is pure.

    Changed are arguments that are assigned to, or an item or attribute of which is, attributes of self, and names declared global.
    A name that is only local is no global change.
    """
    walk = _flat(tree)
    places = {id(f): i for _, f, i in walk.functions}
    for name, f, i in walk.functions:
        args, targets, global_names, nonlocals, io = {a.arg for a in f.args.args}, [], set(), set(), False
        for n in walk.nodes[i : walk.ends[i]]:
            kind = n.__class__
            if kind is ast.Assign:
                targets += n.targets
            elif kind is ast.AugAssign:
                targets.append(n.target)
            elif kind is ast.Global:
                global_names.update(n.names)
            elif kind is ast.Nonlocal:
                nonlocals.update(n.names)
            elif kind is ast.Call:
                io = io or _does_io(n)
        inner = [t for t in targets if isinstance(t, (ast.Attribute, ast.Subscript)) and isinstance(t.value, ast.Name)]
        own = {t.attr for t in inner if isinstance(t, ast.Attribute) and t.value.id == "self"}
        bound = {t.id for t in targets if isinstance(t, ast.Name)} | {t.value.id for t in inner if not (isinstance(t, ast.Attribute) and t.value.id == "self")}
        held = args | {t.id for n in f.body if isinstance(n, ast.Assign) for t in n.targets if isinstance(t, ast.Name)}
        nested = [places[id(n)] for n in f.body if isinstance(n, ast.FunctionDef)]
        captured = {x.id for k in nested for x in walk.nodes[k : walk.ends[k]] if isinstance(x, ast.Name) and isinstance(x.ctx, ast.Load)} & held
        row = {"name": name, "line": f.lineno, "mutated_args": sorted(bound & args), "mutated_globals": sorted(global_names), "self_mutations": sorted(own), "nonlocals": sorted(nonlocals), "captures": sorted(captured), "io": io}
        yield row | {"is_pure": not (row["mutated_args"] or row["mutated_globals"] or row["self_mutations"] or row["io"])}


def intent(tree: ast.Module, text: str) -> tuple[str | None, list[str]]:
    """The module's docstring and its section headings, each once, in order."""
    found: dict[str, None] = {}
    rows = text.splitlines()
    for i, line in enumerate(rows):
        if "===" in line and (m := _SECTION.match(line)):
            title = m[1] or (rows[i + 1].strip().lstrip("#").strip() if i + 1 < len(rows) and rows[i + 1].lstrip().startswith("#") else "")
            if title and title.strip("= "):
                found[title] = None
    return ast.get_docstring(tree), list(found)


def exposure(tree: ast.Module) -> Iterator[tuple[str, str]]:
    """Names that are reached other than by calls: (symbol, reflection | serialization | cli_exposure | api_exposure | registry).

    Reflection names a symbol in a string, its last argument; serialization takes one as its first; decorators expose what they decorate.
    """
    called = lambda f: f.id if isinstance(f, ast.Name) else f.attr if isinstance(f, ast.Attribute) else None
    for node in _flat(tree).nodes:
        kind = node.__class__
        if kind is ast.FunctionDef or kind is ast.ClassDef:
            names = {called(d.func) if isinstance(d, ast.Call) else d.id for d in node.decorator_list if isinstance(d, (ast.Call, ast.Name))}
            yield from ((node.name, kind) for kind, words in DECORATORS.items() if names & set(words))
        elif kind is ast.Call and node.args:
            first, last = node.args[0], node.args[-1]
            if called(node.func) in REFLECTION and isinstance(last, ast.Constant) and isinstance(last.value, str):
                yield last.value, "reflection"
            elif called(node.func) in SERIALIZATION and isinstance(first, ast.Name):
                yield first.id, "serialization"


def statement_spans(tree: ast.Module) -> Iterator[tuple[int, int]]:
    """First and last line of every statement and definition."""
    yield from ((n.lineno, n.end_lineno) for n in ast.walk(tree) if isinstance(n, (ast.stmt, ast.ExceptHandler)) and n.end_lineno)


def spans_of(text: str) -> Callable[[int, int], tuple[int, int]]:
    """For a text, what tells the lines that a hit at a line and column belongs to, the text being read once.

    A block of comments, else a string over several lines, else the smallest statement, else the line.
    """
    rows = text.split("\n")
    comments, strings = set(), []
    try:
        for t in tokenize.generate_tokens(io.StringIO(text).readline):
            if t.type == tokenize.COMMENT:
                comments.add((t.start[0], t.start[1]))
            elif t.type == tokenize.STRING and t.end[0] > t.start[0]:
                strings.append((t.start[0], t.end[0]))
    except (tokenize.TokenError, SyntaxError):
        pass
    whole = {n for n, c in comments if not rows[n - 1][:c].strip()}
    begins = dict(comments)
    # the smallest statement over each line: larger ones are written first
    over: dict[int, tuple[int, int]] = {}
    try:
        for s in sorted(statement_spans(ast.parse(text)), key=lambda s: (s[0] - s[1], -s[0])):
            over.update(dict.fromkeys(range(s[0], s[1] + 1), s))
    except (SyntaxError, ValueError):
        pass

    def span(line: int, column: int) -> tuple[int, int]:
        if line in begins and begins[line] < column:
            if line not in whole:
                return line, line
            first = last = line
            while first - 1 in whole:
                first -= 1
            while last + 1 in whole:
                last += 1
            return first, last
        for a, b in strings:
            if a <= line <= b:
                return a, b
        return over.get(line, (line, line))

    return span


def logical_span(text: str, line: int, column: int) -> tuple[int, int]:
    """The lines that one hit belongs to; see :func:`spans_of`."""
    return spans_of(text)(line, column)


def _encoder() -> Callable[[object], str]:
    """``json.dumps`` with its defaults; the encoder is made once, which a short value spends most of its time on."""
    import json
    from json import encoder

    if encoder.c_make_encoder is None:
        return json.dumps
    pieces = encoder.c_make_encoder(None, json.JSONEncoder().default, encoder.encode_basestring_ascii, None, ": ", ", ", False, False, True)
    return lambda value: "".join(pieces(value, 0))


_json = _encoder()


def facts(path: str, content: bytes, families: tuple[str, ...] | None = None) -> Iterator[dict]:
    """All facts of a file, or those of some families, as rows of a family and a JSON value; a file that can't be parsed gives one row ``skipped``."""
    text, tree, reason, line, column = read(content)
    if tree is None:
        if families is None or "skipped" in families:
            yield {"family": "skipped", "value": _json({"reason": reason, "line_number": line, "column_number": column})}
        return

    def module() -> Iterator[dict]:
        doc, sections = intent(tree, text)
        yield {"doc": doc, "sections": sections, "sha256": hashlib.sha256(content).hexdigest(), "size": len(content)}

    for family, rows in (
        ("module", module()), ("imports", imports(tree)), ("symbols", symbols(tree)), ("collisions", collision_facts(tree, text)), ("api", api_surface(tree)), ("functions", function_metrics(tree)), ("state", function_state(tree)),
        ("usage", ({"channel": c, "value": v, "extra": x} for c, v, x in usage_facts(tree))), ("exports", ({"name": n, "listed": x} for n, x in exports(tree))),
        ("import_usage", ({"name": n, "runtime": a, "typing": b} for n, a, b in import_usage(tree, text))), ("exposure", ({"symbol": s, "kind": k} for s, k in exposure(tree))),
    ):
        if families is None or family in families:
            yield from ({"family": family, "value": _json(r)} for r in rows)
    tree.__dict__.pop("_walked", None)
