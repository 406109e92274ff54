"""Syntax providers: what turns a source text into a tree of byte spans.

A provider has ``parse(source) -> Node``. ``TreeSitter`` is used where its Python package and a grammar can be imported; else ``PythonAst``
reads Python with the standard library, ``Braced`` languages with braces and ``Ended`` Ruby by their key words, and ``Indented`` takes any
text by its blank lines and indentation.
"""

from __future__ import annotations

import ast
import importlib
import re
from dataclasses import dataclass, field
from functools import lru_cache
from typing import Protocol

from ..functions.text import EXTENSIONS


@dataclass
class Node:
    kind: str
    start: int
    end: int
    children: list[Node] = field(default_factory=list)

    def flat(self) -> list[tuple[int, int | None, int, int, str, int, int]]:
        """(id, parent, order, depth, kind, start, end) of all nodes, parents first."""
        out, todo = [], [(self, None, 0, 0)]
        while todo:
            n, parent, order, depth = todo.pop()
            me = len(out)
            out.append((me, parent, order, depth, n.kind, n.start, n.end))
            todo += [(c, me, i, depth + 1) for i, c in reversed(list(enumerate(n.children)))]
        return out


class Provider(Protocol):
    def parse(self, source: str) -> Node: ...


class Indented:
    """Blocks of lines between blank lines at the least indentation; deeper blocks nest."""

    def parse(self, source: str) -> Node:
        lines, at = [], 0
        for raw in source.encode().splitlines(keepends=True):
            body = raw.strip()
            lines.append((at, at + len(raw), len(raw) - len(raw.lstrip()) if body else None))
            at += len(raw)
        return Node("source", 0, at, self._blocks(lines, 0))

    def _blocks(self, lines: list[tuple[int, int, int | None]], depth: int) -> list[Node]:
        full = [x for x in lines if x[2] is not None]
        if not full or depth > 100:
            return []
        least = min(x[2] for x in full)
        groups: list[list] = []
        blank = True
        for x in lines:
            if x[2] is None:
                blank = True
                continue
            if not groups or x[2] == least and (blank or len(groups[-1]) > 1):
                groups.append([])
            groups[-1].append(x)
            blank = False
        out = []
        for g in groups:
            head = Node("line", g[0][0], g[0][1])
            kids = self._blocks(g[1:], depth + 1) if len(g) > 1 else []
            out.append(Node("block", g[0][0], g[-1][1], [head, *kids]) if kids else head)
        return out


class PythonAst:
    """Statements of Python by the standard library's parser; other text, and broken code, by indentation."""

    _KINDS = {"FunctionDef": "function_definition", "AsyncFunctionDef": "function_definition", "ClassDef": "class_definition", "Import": "import_statement", "ImportFrom": "import_statement"}

    def parse(self, source: str) -> Node:
        try:
            tree = ast.parse(source)
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            return Indented().parse(source)
        starts = [0]
        for raw in source.encode().splitlines(keepends=True):
            starts.append(starts[-1] + len(raw))

        def node(x: ast.stmt) -> Node:
            first = min([x.lineno, *(d.lineno for d in getattr(x, "decorator_list", []))])
            begin = starts[first - 1] if first != x.lineno else starts[x.lineno - 1] + x.col_offset
            kids = [node(c) for part in ("body", "handlers", "orelse", "finalbody") for c in getattr(x, part, []) if isinstance(c, ast.stmt)]
            kids.sort(key=lambda k: k.start)
            if kids and kids[0].start > begin:
                kids.insert(0, Node("header", begin, kids[0].start))
            name = type(x).__name__
            return Node(self._KINDS.get(name, name.lower()), begin, starts[x.end_lineno - 1] + x.end_col_offset, kids)

        return Node("module", 0, starts[-1], [node(x) for x in tree.body])


#: Of each language: whether a line end ends a statement, whether # begins a comment, and whether ' begins a string rather than a character.
_BRACED = {"cpp": (False, False, False), "dart": (False, False, True), "go": (True, False, False), "java": (False, False, False), "javascript": (True, False, True), "php": (False, True, True), "php_only": (False, True, True), "rust": (False, False, False), "tsx": (True, False, True), "typescript": (True, False, True)}
_LONG = rb"\"\"\".*?(?:\"\"\"|\Z)|'''.*?(?:'''|\Z)|r#+\".*?(?:\"#+|\Z)|R\"\(.*?(?:\)\"|\Z)|`(?:\\.|[^`\\])*(?:`|\Z)"
_DOUBLE, _STRING, _CHARACTER = rb"\"(?:\\.|[^\"\\])*(?:\"|\Z)", rb"'(?:\\.|[^'\\])*(?:'|\Z)", rb"'(?:\\[^\n]+?|[^'\\\n])'"
_COMMENT = rb"//[^\n]*|/\*.*?(?:\*/|\Z)"
_TYPES = re.compile(rb"\b(?:class|interface|struct|enum|union|trait|impl|mixin|extension|namespace|mod|record|type)\b")
_MARKED = re.compile(rb"#!?\[[^\]]*\]|@[\w.]+(?:\([^)]*\))?")
_CALLABLE = re.compile(rb"\b(?:func|fn|function)\b|[\w$>~]\s*\([^;]*\)[^;=]*$|=>\s*$", re.S)
_CONTROL = re.compile(rb"\s*(?:\}\s*)?(if|for|while|switch|try|catch|else|do|return|match|loop|foreach|finally|select|unsafe|case|default)\b")
_IMPORT = re.compile(rb"\s*(?:#\s*include|import|package|use|using|export\s+\*|library|part|extern\s+crate|require|include)\b")
_VALUE = re.compile(rb"\s*(?:(?:export|public|private|protected|static|pub(?:\([^)]*\))?|final|late)\s+)*(?:const|let|var|static|final|define)\b")
_OPEN_ENDS, _GOES_ON = tuple(bytes([b]) for b in b",=+-*/&|.(<:?[{"), (b".", b")", b"&", b"|", b"?", b":", b"+", b"*", b"{", b"else", b"catch", b"finally", b"while")


class Braced:
    """Declarations and statements of languages with braces, by brackets and key words; strings and comments are passed over.

    A statement ends at a semicolon or with its block (at the line end where the language has it so). One with a block has a
    header, the block's statements and the closing brace as children.
    """

    def __init__(self, language: str) -> None:
        self.lines, marks, strings = _BRACED[language]
        texts = [_COMMENT, *([rb"#(?!\[)[^\n]*"] if marks else []), _LONG, _DOUBLE, _STRING if strings else _CHARACTER]
        self.token = re.compile(rb"(?P<comment>" + b"|".join(texts[: 1 + marks]) + rb")|(?P<text>" + b"|".join(texts[1 + marks :]) + rb")|[{}()\[\];\n]", re.S)

    def parse(self, source: str) -> Node:
        raw = source.encode()
        root = Node("source", 0, len(raw))
        # an open level: its node, where its current statement begins, the statement's blocks, and the brackets open around the level
        levels: list[list] = [[root, None, [], 0]]
        inner, last = 0, 0  # open round and square brackets, end of the last token

        def touch(at: int, end: int) -> None:
            """A statement begins at the first thing that isn't blank."""
            if levels[-1][1] is None:
                text = raw[at:end]
                if text.strip():
                    levels[-1][1] = at + len(text) - len(text.lstrip())

        def finish(end: int) -> None:
            node, begin, blocks, _ = levels[-1]
            if begin is not None:
                node.children.append(self._statement(raw, begin, end, blocks, node))
            levels[-1][1:3] = [None, []]

        for m in self.token.finditer(raw):
            at, end, t = m.start(), m.end(), m[0]
            touch(last, at)
            last = end
            if m["comment"]:
                if levels[-1][1] is None:
                    levels[-1][0].children.append(Node("comment", at, end))
                continue
            if t == b"\n":
                held = levels[-1][1]
                whole = self.lines and not inner and raw[at - 1 : at] not in _OPEN_ENDS and not raw[end : end + 64].lstrip().startswith(_GOES_ON)
                if held is not None and (whole or raw[held : held + 5] == b"<?php" or raw[held : held + 1] == b"#" and raw[held + 1 : held + 2] != b"["):
                    finish(at)
                continue
            if t != b"}":
                touch(at, end)
            if t in (b"(", b"["):
                inner += 1
            elif t in (b")", b"]"):
                inner = max(0, inner - 1)
            elif t == b"{":
                holds = self._kind(raw[levels[-1][1] : at], True, levels[-1][0]) == "class_declaration"
                levels.append([Node("class_body" if holds else "block", at, end, [Node("{", at, end)]), None, [], inner])
                inner = 0
            elif t == b"}" and len(levels) > 1:
                finish(at)
                block, inner = levels[-1][0], levels[-1][3]
                levels.pop()
                block.end = end
                block.children.append(Node("}", at, end))
                levels[-1][2].append(block)
                if not self.lines and not inner and not raw[end : end + 64].lstrip()[:8].startswith((b";", b",", b".", b")", b"=", *_GOES_ON)):
                    finish(end)
            elif t == b";" and not inner:
                finish(end)
        touch(last, len(raw))
        while len(levels) > 1:  # never closed
            finish(len(raw))
            block, inner = levels[-1][0], levels[-1][3]
            levels.pop()
            block.end = len(raw)
            levels[-1][2].append(block)
        finish(len(raw.rstrip()) or len(raw))
        return root

    def _statement(self, raw: bytes, begin: int, end: int, blocks: list[Node], parent: Node) -> Node:
        head = raw[begin : blocks[0].start if blocks else end]
        kind = self._kind(head, bool(blocks), parent)
        kids, at = [], begin
        for b in blocks:
            if b.start > at and raw[at : b.start].strip():
                kids.append(Node("header", at, b.start))
            kids.append(b)
            at = b.end
        if kids and raw[at:end].strip():
            kids.append(Node("rest", at, end))
        return Node(kind, begin, end, kids)

    @staticmethod
    def _kind(head: bytes, block: bool, parent: Node) -> str:
        head = _MARKED.sub(b"", head)
        if control := _CONTROL.match(head):
            return f"{control[1].decode()}_statement"
        if _IMPORT.match(head):
            return "import_statement"
        plain = head.split(b"(", 1)[0].split(b"=", 1)[0]
        if not block and parent.kind == "class_body":
            return "field_declaration"
        if _VALUE.match(head) and not (block and b"=>" in head):
            return "variable_declaration" if not _TYPES.search(plain) else "class_declaration"
        if _TYPES.search(plain):
            return "class_declaration" if block else "type_declaration"
        if block and _CALLABLE.search(head) or re.match(rb"\s*(?:export\s+|async\s+|pub\s+)*(?:func|fn|function)\b", head):
            return "method_declaration" if parent.kind == "class_body" else "function_declaration"
        return "block_statement" if block else "expression_statement"


class Ended:
    """Ruby: statements by lines, with what opens at a key word and is closed by ``end`` as one."""

    _OPENS = re.compile(r"^\s*(?:(?:private|public|protected)\s+)?(class|module|def|if|unless|while|until|case|begin|for)\b|\bdo\b(?:\s*\|[^|]*\|)?\s*(?:#.*)?$|=\s*(?:if|case|begin)\b")
    _KINDS = {"class": "class_definition", "module": "module_definition", "def": "method_definition"}

    def parse(self, source: str) -> Node:
        root = Node("program", 0, len(source.encode()))
        stack, at, quoted = [root], 0, False
        for raw in source.splitlines(keepends=True):
            begin, at = at, at + len(raw.encode())
            text = raw.strip()
            if text.startswith("=begin") or text.startswith("=end"):
                quoted = text.startswith("=begin")
            if not text:
                continue
            start = begin + len(raw[: len(raw) - len(raw.lstrip())].encode())
            end = begin + len(raw.rstrip("\r\n").encode())
            line = Node("comment" if quoted or text.startswith(("#", "=")) else "line", start, end)
            if line.kind == "comment":
                stack[-1].children.append(line)
            elif re.match(r"end\b", text) and len(stack) > 1:
                stack[-1].children.append(line)
                stack.pop().end = end
            elif (m := self._OPENS.search(raw)) and not re.search(r"[\s;]end\s*(?:#.*)?$", text) and not re.match(r"\s*def\s+\S+(?:\([^)]*\))?\s*=", raw):
                node = Node(self._KINDS.get(m[1] or "", "block"), start, end, [Node("header", start, end)])
                stack[-1].children.append(node)
                stack.append(node)
            else:
                stack[-1].children.append(line)
        while len(stack) > 1:
            stack.pop().end = root.end
        return root


class TreeSitter:
    """Trees of the ``tree_sitter`` package, for a language object that the caller brings."""

    def __init__(self, language) -> None:
        self.language = language

    def parse(self, source: str) -> Node:
        from tree_sitter import Parser

        def node(n) -> Node:
            return Node(n.type, n.start_byte, n.end_byte, [node(c) for c in n.children])

        return node(Parser(self.language).parse(source.encode()).root_node)


#: Packages whose grammar isn't their function ``language``.
_GRAMMARS = {"tsx": ("typescript", "language_tsx"), "typescript": ("typescript", "language_typescript"), "php": ("php", "language_php"), "php_only": ("php", "language_php_only")}


def grammar_of(language: str):
    """The tree-sitter grammar of a language, where the package and that of the language are installed, or null."""
    package, name = _GRAMMARS.get(language, (language, "language"))
    try:
        tree_sitter, module = importlib.import_module("tree_sitter"), importlib.import_module(f"tree_sitter_{package}")
    except ImportError:
        return None
    return tree_sitter.Language(getattr(module, name)())


@lru_cache
def provider_for(language: str | None) -> Provider:
    """What reads a language: its grammar where it is installed, else Python's own parser, brackets or indentation."""
    grammar = grammar_of(language) if language in EXTENSIONS.values() else None
    if grammar is not None:
        return TreeSitter(grammar)
    return PythonAst() if language == "python" else Braced(language) if language in _BRACED else Ended() if language == "ruby" else Indented()
