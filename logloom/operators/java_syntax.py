"""A tolerant reader of Java source: enough syntax to find logging calls and the statements that build their messages.

``facts(source)`` gives plain rows (dicts); everything that follows from them is done on DataFrames. Unknown syntax is skipped token by
token, so a strange construct costs its own facts only.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from logloom.functions.text import FORMAT_SPECIFIER

HOLE, MARKER = "<*>", "<!PLACEHOLDER!>"
TOKEN = re.compile(
    r"""(?P<skip>\s+|//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<text>\"\"\".*?(?:\"\"\"|\Z))|(?P<string>"(?:\\.|[^"\\\n])*"?)|(?P<char>'(?:\\.|[^'\\\n])*'?)"""
    r"""|(?P<number>\.?\d[\w.]*)|(?P<name>[^\W\d][\w$]*|\$[\w$]*)|(?P<op>->|::|\+\+|--|&&|\|\||[=!<>+\-*/%&|^]=|\.\.\.|.)""",
    re.S,
)
TYPES = {"class", "interface", "enum", "record", "@interface"}
MODIFIERS = {"public", "private", "protected", "static", "final", "abstract", "synchronized", "native", "transient", "volatile", "default", "strictfp", "sealed"}
#: Method names whose first name or literal argument is shown in a marker.
SHOWN = {"addPrefix", "addSuffix", "format", "toString", "getMessage", "getLocalizedMessage"}
#: Kinds of arguments that count as arguments of a logging call.
COUNTED = {"string", "binary", "call", "name", "null"}
BINDING = {"||": 1, "&&": 2, "|": 3, "^": 4, "&": 5, "==": 6, "!=": 6, "<": 7, ">": 7, "<=": 7, ">=": 7, "+": 9, "-": 9, "*": 10, "/": 10, "%": 10}
ASSIGN = {"=", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^="}


@dataclass
class Token:
    kind: str
    text: str
    line: int
    start: int
    end: int


@dataclass
class Node:
    """kind: string, null, name, field, binary, call, assign, lambda, new, other."""

    kind: str
    line: int
    start: int
    end: int = 0
    name: str = ""
    op: str = ""
    parts: list = field(default_factory=list)  # operands, or a call's receiver (or None)
    args: list = field(default_factory=list)
    text: str = ""


@dataclass
class Scope:
    number: int
    kind: str  # method, constructor, initializer or lambda
    class_name: str | None
    class_id: int
    method_name: str | None
    classes: tuple  # names of enclosing class declarations, once for each enclosing method in them
    counted: bool  # whether a method encloses it


def tokenized(source: str) -> list[Token]:
    out, line, last = [], 1, 0
    for m in TOKEN.finditer(source):
        line += source.count("\n", last, m.start())
        last = m.start()
        if m.lastgroup != "skip":
            out.append(Token(m.lastgroup, m[0], line, m.start(), m.end()))
    return out


class Reader:
    def __init__(self, source: str):
        self.source, self.toks, self.i = source, tokenized(source), 0
        self.out = {"scopes": [], "calls": [], "stmts": [], "params": [], "fields": []}
        self.scope: Scope | None = None
        self.classes: list[tuple[int, str | None, int]] = []  # (id, name or None, methods around its start)
        self.methods: list[int] = []  # class depth of each enclosing method
        self.n_classes = self.n_scopes = self.n_branches = 0
        self.seq = 0
        self.path: list[str] = []

    # Tokens --------------------------------------------------------------------------------------------------------------------
    def peek(self, k: int = 0) -> str:
        return self.toks[self.i + k].text if self.i + k < len(self.toks) else ""

    def kind(self, k: int = 0) -> str:
        return self.toks[self.i + k].kind if self.i + k < len(self.toks) else ""

    def line(self) -> int:
        return self.toks[min(self.i, len(self.toks) - 1)].line if self.toks else 1

    def at(self) -> int:
        return self.toks[self.i].start if self.i < len(self.toks) else len(self.source)

    def before(self) -> int:
        return self.toks[self.i - 1].end if self.i else 0

    def take(self, text: str) -> bool:
        if self.peek() == text:
            self.i += 1
            return True
        return False

    def balanced(self, a: str, b: str) -> None:
        """Skips from ``a`` to its ``b``."""
        depth = 0
        while self.i < len(self.toks):
            t = self.peek()
            depth += (t == a) - (t == b)
            self.i += 1
            if depth <= 0:
                return

    def done(self) -> bool:
        return self.i >= len(self.toks)

    # Declarations --------------------------------------------------------------------------------------------------------------
    def file(self) -> None:
        while not self.done():
            if not self.member():
                self.i += 1

    def modifiers(self) -> set[str]:
        found = set()
        while True:
            if self.peek() == "@" and self.peek(1) != "interface":
                self.i += 2
                while self.take("."):
                    self.i += 1
                if self.peek() == "(":
                    self.balanced("(", ")")
            elif self.peek() in MODIFIERS and not (self.peek() in ("default", "record", "sealed") and self.peek(1) in (":", "->")):
                found.add(self.peek())
                self.i += 1
            elif self.peek() == "non" and self.peek(1) == "-":
                self.i += 3
            else:
                return found

    def type_end(self, i: int) -> int:
        """Index after a type that starts at ``i``, or -1."""
        if i >= len(self.toks) or self.toks[i].kind != "name":
            return -1
        i += 1
        while i < len(self.toks):
            t = self.toks[i].text
            if t == "<":
                depth = 0
                while i < len(self.toks):
                    t = self.toks[i].text
                    if t not in "<>,.?&[]@" and self.toks[i].kind != "name":
                        return -1
                    depth += (t == "<") - (t == ">")
                    i += 1
                    if depth == 0:
                        break
            elif t == "." and i + 1 < len(self.toks) and self.toks[i + 1].kind == "name":
                i += 2
            elif t == "[" and i + 1 < len(self.toks) and self.toks[i + 1].text == "]":
                i += 2
            elif t == "...":
                i += 1
            else:
                break
        return i

    def member(self) -> bool:
        """One member of a type (or of the file)."""
        start = self.i
        if self.take(";"):
            return True
        mods = self.modifiers()
        word = self.peek()
        if word == "@" and self.peek(1) == "interface":
            self.i += 1
            word = "interface"
        if word in TYPES and self.kind(1) == "name":
            self.type_declaration(word)
            return True
        if word == "{":
            self.body("initializer", None)
            return True
        if word == "<":
            self.balanced("<", ">")
        if self.kind() == "name" and self.peek(1) in ("(", "{") and self.classes:
            name = self.peek()
            self.i += 1
            if self.peek() == "(" or self.peek() == "{":
                self.method(name, "constructor")
                return True
        end = self.type_end(self.i)
        if end > 0 and end < len(self.toks) and self.toks[end].kind == "name":
            after = self.toks[end + 1].text if end + 1 < len(self.toks) else ""
            if after == "(":
                self.i = end + 1
                self.method(self.toks[end].text, "method")
                return True
            if after in ("=", ";", ",", "["):
                self.i = end
                self.field_declaration(mods)
                return True
        self.i = start
        return False

    def type_declaration(self, word: str) -> None:
        self.i += 1
        name = self.peek()
        self.i += 1
        while not self.done() and self.peek() not in ("{", ";"):
            if self.peek() == "(":
                self.balanced("(", ")")
            else:
                self.i += 1
        self.type_body(name if word == "class" else None, enum=word == "enum", declared=word == "class")

    def type_body(self, name: str | None, enum: bool = False, declared: bool = True) -> None:
        if not self.take("{"):
            return
        self.n_classes += 1
        outer = self.classes[-1] if self.classes else (0, None, 0)
        # Anonymous types, enums, interfaces and records have no name of their own: the class around them stands for them.
        self.classes.append((self.n_classes if declared else outer[0], name if declared else outer[1], declared))
        kept, self.scope, path, self.path = self.scope, None, self.path, []
        if enum:
            while not self.done() and self.peek() not in (";", "}"):
                if self.peek() == "(":
                    self.balanced("(", ")")
                elif self.peek() == "{":
                    self.type_body(None, declared=False)
                else:
                    self.i += 1
        while not self.done() and self.peek() != "}":
            if not self.member():
                self.i += 1
        self.take("}")
        self.classes.pop()
        self.scope, self.path = kept, path

    def field_declaration(self, mods: set[str]) -> None:
        class_id = self.classes[-1][0] if self.classes else 0
        while self.kind() == "name":
            name = self.peek()
            self.i += 1
            while self.take("["):
                self.take("]")
            value = None
            if self.take("="):
                value = self.in_scope("initializer", None, self.expression)
            self.out["fields"].append({"class_id": class_id, "name": name, "constant": {"static", "final"} <= mods, "pattern": (slice_pattern(value) if value else None) or None})
            if not self.take(","):
                break
        self.take(";")

    def enclosing(self) -> tuple:
        """Names of the class declarations around, once for each method around that lies in them."""
        out = []
        for depth, (_, name, declared) in enumerate(self.classes):
            if declared:
                out += [name] * sum(d > depth for d in self.methods)
        return tuple(out) or ((None,) if self.methods else ())

    def in_scope(self, kind: str, name: str | None, run, params: list[str] = ()):
        self.n_scopes += 1
        outer, path, self.path = self.scope, self.path, []
        if kind == "method":
            self.methods.append(len(self.classes))
        class_id, class_name = (self.classes[-1][0], self.classes[-1][1]) if self.classes else (0, None)
        method = name if kind == "method" else outer.method_name if outer else name
        self.scope = Scope(self.n_scopes, kind, class_name, class_id, method, self.enclosing(), bool(self.methods))
        self.out["scopes"].append({"scope_id": self.n_scopes, "kind": kind, "class_id": class_id, "class_name": class_name, "method_name": method})
        self.out["params"] += [{"scope_id": self.n_scopes, "name": p} for p in params]
        out = run()
        self.scope, self.path = outer, path
        if kind == "method":
            self.methods.pop()
        return out

    def method(self, name: str, kind: str) -> None:
        params = self.parameters() if self.peek() == "(" else []
        while not self.done() and self.peek() not in ("{", ";"):
            self.i += 1
        self.body(kind, name, params) if self.peek() == "{" else self.take(";")

    def parameters(self) -> list[str]:
        out, end = [], self.i
        depth = angle = 0
        last, varied = None, False
        while end < len(self.toks):
            t = self.toks[end]
            depth += (t.text == "(") - (t.text == ")")
            angle += (t.text == "<") - (t.text == ">")
            if t.text == "...":
                varied = True
            if depth == 0 or (depth == 1 and angle == 0 and t.text == ","):
                if last and not varied:
                    out.append(last)
                last, varied = None, False
                if depth == 0:
                    break
            elif t.kind == "name" and depth == 1 and angle == 0:
                last = t.text
            end += 1
        self.i = end + 1
        return out

    def body(self, kind: str, name: str | None, params: list[str] = ()) -> None:
        self.in_scope(kind, name, self.block, params)

    # Statements ----------------------------------------------------------------------------------------------------------------
    def statement_row(self, line: int, uses: list[str], defs: list[tuple[str, str | None]]) -> None:
        if self.scope is None:
            return
        self.seq += 1
        self.out["stmts"].append(
            {"scope_id": self.scope.number, "seq": self.seq, "line": line, "uses": sorted(set(uses)), "defs": [{"var": v, "pattern": p} for v, p in defs], "path": list(self.path)}
        )

    def reserve(self, line: int) -> dict | None:
        """A compound statement's row, in pre-order before the statements within it."""
        if self.scope is None:
            return None
        self.statement_row(line, [], [])
        return self.out["stmts"][-1]

    def block(self) -> None:
        self.reserve(self.line())
        if not self.take("{"):
            return
        while not self.done() and self.peek() != "}":
            before = self.i
            self.statement()
            if self.i == before:
                self.i += 1
        self.take("}")

    def arm(self, branch: int, n: int, run) -> None:
        self.path.append(f"{branch}:{n}")
        run()
        self.path.pop()

    def condition(self) -> list[str]:
        uses: list[str] = []
        if self.take("("):
            while not self.done() and self.peek() != ")":
                before = self.i
                if self.take(";") or self.take(",") or self.take(":"):
                    continue
                node = self.declaration_or_expression(quiet=True)
                uses += node
                if self.i == before:
                    self.i += 1
            self.take(")")
        return uses

    def statement(self) -> None:
        word, line = self.peek(), self.line()
        if word == "{":
            return self.block()
        if word == ";":
            self.i += 1
            return None
        if self.kind() == "name" and self.peek(1) == ":" and self.peek(2) != ":" and word not in ("default", "case"):
            self.i += 2
            return self.statement()
        if word in ("if", "while", "for"):
            row = self.reserve(line)
            self.i += 1
            first = len(self.out["stmts"])
            uses = self.condition()
            self.n_branches += 1
            branch = self.n_branches
            self.arm(branch, 0, self.statement)
            if word == "if" and self.take("else"):
                self.arm(branch, 1, self.statement)
            if row is not None:
                row["uses"] = sorted({*uses, *(u for s in self.out["stmts"][first:] if s["scope_id"] == row["scope_id"] for u in s["uses"])})
            return None
        if word == "do":
            self.i += 1
            self.n_branches += 1
            self.arm(self.n_branches, 0, self.statement)
            if self.take("while"):
                self.condition()
            self.take(";")
            return None
        if word == "try":
            self.i += 1
            if self.peek() == "(":
                self.condition()
            self.block()
            self.n_branches += 1
            n = 0
            while self.peek() in ("catch", "finally"):
                last = self.take("finally")
                if not last:
                    self.i += 1
                    self.balanced("(", ")")
                n += 1
                self.arm(self.n_branches, n, self.block) if not last else self.block()
            return None
        if word == "switch":
            self.i += 1
            self.condition()
            self.n_branches += 1
            branch, n = self.n_branches, 0
            if self.take("{"):
                while not self.done() and self.peek() != "}":
                    before = self.i
                    if self.peek() in ("case", "default"):
                        n += 1
                        while not self.done() and self.peek() not in (":", "->", "}"):
                            self.i += 1
                        self.i += 1
                    else:
                        self.arm(branch, n, self.statement)
                    if self.i == before:
                        self.i += 1
                self.take("}")
            self.take(";")
            return None
        if word == "synchronized" and self.peek(1) == "(":
            self.i += 1
            self.condition()
            return self.block()
        if word in ("return", "throw", "yield", "assert"):
            self.i += 1
            node = self.expression() if self.peek() != ";" else None
            while self.take(":"):
                self.expression()
            if word in ("return", "throw"):
                self.statement_row(line, names(node), [])
            self.end()
            return None
        if word in ("break", "continue"):
            self.end()
            return None
        here = self.i
        self.modifiers()
        if self.peek() in TYPES and self.kind(1) == "name" and self.kind(2) != "name" and self.peek(2) in ("{", "(", "<", "extends", "implements"):
            self.type_declaration(self.peek())
            return None
        if self.peek() in ("class", "interface", "enum") and self.kind(1) == "name":
            self.type_declaration(self.peek())
            return None
        self.i = here
        self.declaration_or_expression()
        self.end()
        return None

    def end(self) -> None:
        """Up to the statement's semicolon, without leaving its block."""
        while not self.done() and self.peek() not in (";", "}"):
            if self.peek() == "{":
                self.balanced("{", "}")
            else:
                self.i += 1
        self.take(";")

    def declaration_or_expression(self, quiet: bool = False) -> list[str]:
        line = self.line()
        start = self.i
        self.modifiers()
        end = self.type_end(self.i)
        if end > 0 and end < len(self.toks) and self.toks[end].kind == "name" and self.toks[end].text != "instanceof" and self.peek() not in ("return", "new", "throw", "else"):
            after = self.toks[end + 1].text if end + 1 < len(self.toks) else ""
            if after in ("=", ";", ",", ":", "[", ")"):
                self.i = end
                defs, uses = [], []
                place = len(self.out["stmts"])
                while self.kind() == "name":
                    var = self.peek()
                    self.i += 1
                    while self.take("["):
                        self.take("]")
                    value = self.initializer() if self.take("=") else None
                    uses += names(value)
                    defs.append((var, (slice_pattern(value) if value else None) or None))
                    if not self.take(","):
                        break
                # A loop's head is a statement of its own only in a plain for, where it is a declaration within the loop.
                if not quiet or self.peek() == ";":
                    self.insert(place, line, uses, defs)
                return uses
        self.i = start
        place = len(self.out["stmts"])
        node = self.expression()
        defs = [(node.parts[0].name, slice_pattern(node.parts[1]) or None)] if node.kind == "assign" and node.parts[0].kind == "name" else []
        if not quiet:
            self.insert(place, line, names(node), defs)
        return names(node)

    def insert(self, place: int, line: int, uses, defs) -> None:
        """A statement's row goes before those of lambda bodies within it."""
        self.statement_row(line, uses, defs)
        if self.scope is not None:
            self.out["stmts"].insert(place, self.out["stmts"].pop())

    def initializer(self) -> Node:
        if self.peek() == "{":
            node = Node("other", self.line(), self.at())
            self.i += 1
            while not self.done() and self.peek() != "}":
                before = self.i
                node.parts.append(self.initializer())
                self.take(",")
                if self.i == before:
                    self.i += 1
            self.take("}")
            return self.closed(node)
        return self.expression()

    # Expressions ---------------------------------------------------------------------------------------------------------------
    def closed(self, node: Node) -> Node:
        node.end = self.before()
        node.text = self.source[node.start : node.end]
        return node

    def expression(self) -> Node:
        line, start = self.line(), self.at()
        if self.is_lambda():
            return self.lambda_expression()
        left = self.ternary()
        if self.peek() in ASSIGN or (self.peek() in ("<", ">") and self.shifted_assign()):
            op = self.peek()
            self.i += 1
            right = self.expression()
            return self.closed(Node("assign", line, start, op=op, parts=[left, right]))
        return left

    def shifted_assign(self) -> bool:
        k = 0
        while self.peek(k) in ("<", ">"):
            k += 1
        if k >= 1 and self.peek(k) in ("<=", ">="):
            self.i += k
            return True
        return False

    def is_lambda(self) -> bool:
        if self.kind() == "name" and self.peek(1) == "->":
            return True
        if self.peek() != "(":
            return False
        depth, k = 0, self.i
        while k < len(self.toks):
            t = self.toks[k].text
            depth += (t == "(") - (t == ")")
            k += 1
            if depth == 0:
                return k < len(self.toks) and self.toks[k].text == "->"
            if t in (";", "{", "}"):
                return False
        return False

    def lambda_expression(self) -> Node:
        node = Node("lambda", self.line(), self.at())
        if self.peek() == "(":
            self.balanced("(", ")")
        else:
            self.i += 1
        self.take("->")
        if self.peek() == "{":
            self.in_scope("lambda", self.scope.method_name if self.scope else None, self.block)
        else:
            node.parts.append(self.expression())
        return self.closed(node)

    def ternary(self) -> Node:
        line, start = self.line(), self.at()
        test = self.binary(0)
        if self.peek() == "?":
            self.i += 1
            yes = self.expression()
            self.take(":")
            no = self.expression()
            return self.closed(Node("other", line, start, parts=[test, yes, no]))
        return test

    def binary(self, least: int) -> Node:
        line, start = self.line(), self.at()
        left = self.unary()
        while True:
            op, width = self.peek(), 1
            if op in ("<", ">") and self.peek(1) == op and self.toks[self.i].end == self.toks[self.i + 1].start:
                width = 3 if self.peek(2) == op else 2
                if self.peek(width) in (">=", "<="):
                    return left
                power = 8
            elif op == "instanceof":
                self.i += 1
                self.modifiers()
                end = self.type_end(self.i)
                self.i = end if end > 0 else self.i
                if self.kind() == "name" and self.peek() != "instanceof":
                    self.i += 1
                elif self.peek() == "(":
                    self.balanced("(", ")")
                left = self.closed(Node("other", line, start, parts=[left]))
                continue
            else:
                power = BINDING.get(op, 0)
            if power <= least:
                return left
            self.i += width
            right = self.binary(power)
            left = self.closed(Node("binary", line, start, op=op * width if width > 1 else op, parts=[left, right]))

    def unary(self) -> Node:
        line, start = self.line(), self.at()
        if self.peek() in ("+", "-", "!", "~", "++", "--"):
            self.i += 1
            return self.closed(Node("other", line, start, parts=[self.unary()]))
        if self.peek() == "(" and self.is_cast():
            self.balanced("(", ")")
            inner = self.lambda_expression() if self.is_lambda() else self.unary()
            return self.closed(Node("other", line, start, parts=[inner]))
        return self.postfix(self.primary(), line, start)

    def is_cast(self) -> bool:
        end = self.type_end(self.i + 1)
        while 0 < end < len(self.toks) and self.toks[end].text == "&":
            end = self.type_end(end + 1)
        if end < 0 or end + 1 >= len(self.toks) or self.toks[end].text != ")":
            return False
        after = self.toks[end + 1]
        primitive = end == self.i + 2 and self.peek(1) in ("int", "long", "double", "float", "short", "byte", "char", "boolean")
        return primitive or after.kind in ("name", "string", "char", "number", "text") and after.text != "instanceof" or after.text in ("(", "!", "~")

    def primary(self) -> Node:
        t, kind = self.peek(), self.kind()
        node = Node("other", self.line(), self.at())
        if kind in ("string", "text"):
            node.kind = "string"
            self.i += 1
        elif t == "null":
            node.kind = "null"
            self.i += 1
        elif t == "(":
            self.i += 1
            node.parts.append(self.expression())
            self.take(")")
        elif t == "new":
            self.i += 1
            node.kind = "new"
            end = self.type_end(self.i)
            node.name = self.source[self.at() : self.toks[end - 1].end] if end > 0 else ""
            self.i = end if end > 0 else self.i + 1
            if self.peek() == "(":
                node.args = self.arguments()
                if self.peek() == "{":
                    self.type_body(None, declared=False)
            else:
                while self.take("["):
                    if self.peek() != "]":
                        node.args.append(self.expression())
                    self.take("]")
                if self.peek() == "{":
                    node.args.append(self.initializer())
        elif t == "switch":
            self.statement()
        elif kind == "name":
            node.kind = "name"
            node.name = t
            self.i += 1
            if t in ("true", "false", "this", "super"):
                node.kind = "other"
            if self.peek() == "(":
                node = self.call(None, node)
        elif kind in ("number", "char"):
            self.i += 1
        elif t not in (")", "}", "]", ";", ",", ":"):
            self.i += 1
        return self.closed(node)

    def postfix(self, node: Node, line: int, start: int) -> Node:
        while not self.done():
            if self.peek() == ".":
                self.i += 1
                if self.peek() == "<":
                    self.balanced("<", ">")
                if self.peek() == "new":
                    node = self.closed(Node("other", line, start, parts=[node, self.primary()]))
                    continue
                name = Node("name", self.line(), self.at(), name=self.peek())
                self.i += 1
                if self.peek() == "(":
                    name.line, name.start = line, start
                    node = self.call(node, name)
                else:
                    node = self.closed(Node("field", line, start, name=name.name, parts=[node]))
            elif self.peek() == "[":
                self.i += 1
                inner = [self.expression()] if self.peek() != "]" else []
                self.take("]")
                node = self.closed(Node("other", line, start, parts=[node, *inner]))
            elif self.peek() in ("++", "--"):
                self.i += 1
                node = self.closed(Node("other", line, start, parts=[node]))
            elif self.peek() == "::":
                self.i += 2
                node = self.closed(Node("other", line, start, parts=[node]))
            else:
                return node
        return node

    def arguments(self) -> list[Node]:
        out = []
        self.take("(")
        while not self.done() and self.peek() != ")":
            before = self.i
            out.append(self.expression())
            if self.i == before:
                self.i += 1
            self.take(",")
            if self.peek() in (";", "}"):
                break
        self.take(")")
        return out

    def call(self, receiver: Node | None, name: Node) -> Node:
        node = Node("call", name.line, name.start, name=name.name, parts=[receiver])
        scope = self.scope
        node.args = self.arguments()
        self.closed(node)
        if scope is not None:
            self.out["calls"].append(call_row(node, scope, list(self.path)))
        return node


# Folding of expressions ------------------------------------------------------------------------------------------------------------
def unquoted(text: str) -> str:
    return text[1:-1] if len(text) > 1 and text[0] == text[-1] and text[0] in "\"'" else text


def names(node: Node | None) -> list[str]:
    """Identifiers used in an expression: all but the plain target of an assignment; method names count too."""
    if node is None:
        return []
    if node.kind == "name":
        return [node.name]
    out = [node.name] if node.kind in ("call", "field") else []
    parts = node.parts[1:] if node.kind == "assign" and node.parts[0].kind == "name" else node.parts
    return out + [x for p in (*parts, *node.args) for x in names(p)]


def is_plus(node: Node) -> bool:
    return node.kind == "binary" and node.op == "+"


def literal_text(node: Node) -> str | None:
    """Joined literals of a format string; other parts are left out."""
    if node.kind == "string":
        return unquoted(node.text)
    if is_plus(node):
        found = [x for x in map(literal_text, node.parts) if x is not None]
        return "".join(found)
    return "" if node.kind == "binary" else None


def is_format(node: Node) -> bool:
    return node.kind == "call" and node.name == "format" and bool(node.parts[0]) and node.parts[0].text == "String"


def format_pattern(node: Node) -> str | None:
    """Pattern of a String.format call: its first literal (or joined literals) with holes for specifiers."""
    for a in node.args:
        text = literal_text(a) if a.kind in ("string", "binary") else None
        if text or a.kind == "string":
            return re.sub(FORMAT_SPECIFIER, HOLE, text or "")
    return None


def slice_pattern(node: Node | None) -> str:
    """Pattern of a value that a variable is given; the sides of a ``+`` are joined by a space."""
    if node is None:
        return HOLE
    if node.kind == "string":
        return unquoted(node.text)
    if is_plus(node):
        return " ".join(slice_pattern(p) or HOLE for p in node.parts)
    if node.kind == "binary":
        return ""
    if node.kind == "call":
        if node.name == "toString":
            return slice_pattern(node.parts[0])
        pattern = format_pattern(node) if is_format(node) else None
        return pattern if pattern is not None else f"<method:{node.parts[0].text + '.' if node.parts[0] else ''}{node.name}()>"
    return HOLE


def direct_pattern(node: Node, resolve: bool) -> str:
    """Message text of a logging call's argument; names are the marker, which asks for slicing if it stands alone."""
    if node.kind == "string":
        return unquoted(node.text)
    if is_plus(node):
        sides = [direct_pattern(p, resolve) for p in node.parts]
        return "".join(s.replace(MARKER, HOLE) or HOLE for s in sides) if any(sides) else ""
    if node.kind in ("name", "field"):
        return MARKER
    if node.kind == "call":
        if resolve and is_format(node) and format_pattern(node) is not None:
            return format_pattern(node)
        if resolve and node.name == "toString" and (parts := builder_parts(node, blank=True)) is not None:
            return "".join(parts)
        if node.name not in SHOWN:
            return f"<method:{node.name}()>"
        first = next((a for a in node.args if a.kind in ("name", "string")), None)
        return f"<method:{node.name}({unquoted(first.text) if first is not None and first.kind == 'string' else HOLE})>"
    return ""


def concat_parts(node: Node) -> list[str] | None:
    """Parts of a concatenation: literals (blank ones dropped) and holes; null if an operand is another operation."""
    if node.kind == "string":
        text = unquoted(node.text)
        return [text] if text.strip() else []
    if node.kind == "binary":
        if node.op != "+":
            return None
        sides = [concat_parts(p) for p in node.parts]
        return None if None in sides else [x for s in sides for x in s]
    return [HOLE]


def has_concatenation(node: Node) -> bool:
    return is_plus(node) and any(p.kind in ("string", "name", "call", "field") or has_concatenation(p) for p in node.parts)


def builder_parts(node: Node | None, blank: bool = False) -> list[str] | None:
    """Parts of a StringBuilder chain: literals given to the constructor or append, and holes; null if it is no such chain."""
    if node is None:
        return None
    if node.kind == "new" and node.name.split("<")[0] in ("StringBuilder", "StringBuffer"):
        return [unquoted(a.text) for a in node.args if a.kind == "string"] + [HOLE for a in node.args if a.kind not in ("string", "other")]
    if node.kind == "call" and node.name == "toString":
        return builder_parts(node.parts[0], blank)
    if node.kind == "call" and node.name == "append":
        before = builder_parts(node.parts[0], blank)
        if before is None or not node.args:
            return before
        text = unquoted(node.args[0].text) if node.args[0].kind == "string" else HOLE
        return before + [text] if blank or text.strip() else before
    return None


def message_variables(node: Node) -> list[str]:
    """Names whose definitions make up a message argument, in order of place."""
    if node.kind == "name":
        return [node.name]
    if node.kind != "call":
        return []
    out: list[str] = []
    for a in node.args:
        out += [a.name] if a.kind == "name" else message_variables(a) if a.kind == "call" else []
    return [*dict.fromkeys(out)]


def arg_row(node: Node) -> dict:
    return {
        "kind": node.kind, "text": node.text, "direct": direct_pattern(node, False), "resolved": direct_pattern(node, True),
        "format": format_pattern(node) if is_format(node) else None, "concat": concat_parts(node) if has_concatenation(node) else None,
        "builder": builder_parts(node) if node.kind == "call" and node.name in ("append", "toString") else None, "vars": message_variables(node),
    }


def call_row(node: Node, scope: Scope, path: list[str]) -> dict:
    receiver = node.parts[0]
    return {
        "line": node.line, "start": node.start, "receiver": receiver.text if receiver else None, "method": node.name, "scope_id": scope.number, "class_id": scope.class_id,
        "class_name": scope.class_name, "method_name": scope.method_name, "in_method": scope.counted, "enclosing": list(scope.classes), "path": path,
        "args": [arg_row(a) for a in node.args if a.kind in COUNTED],
        "format": format_pattern(node) if is_format(node) else None, "builder": builder_parts(node) if node.name in ("append", "toString") else None,
    }


def facts(source: str) -> dict[str, list[dict]]:
    reader = Reader(source)
    reader.file()
    return reader.out
