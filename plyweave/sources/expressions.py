"""Expressions in runs of tokens: calls, accesses, unary and binary operators, as nested nodes.

The fold never fails and never drops a token: what it does not know stays flat.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field


@dataclass
class Node:
    tag: str
    start: int = 0
    end: int = 0
    named: bool = True
    children: list[Node] = field(default_factory=list)


def over(tag: str, children: Sequence[Node]) -> Node:
    """A node that spans its children."""
    return Node(tag, children[0].start, children[-1].end, True, list(children))


def _longer(node: Node, more: Sequence[Node]) -> Node:
    node.children += more
    node.end = more[-1].end
    return node


@dataclass(frozen=True)
class Names:
    """What a language calls its expressions; ``marks`` are the signs of an access to a member, with the node's tag."""

    call: str
    index: str
    creation: str
    marks: dict[str, str]
    prefix: dict[str, str]


JAVA = Names("method_invocation", "array_access", "object_creation_expression", {".": "field_access", "::": "method_reference"}, {**dict.fromkeys("!~-+", "unary_expression"), "++": "update_expression", "--": "update_expression"})
CPP = Names("call_expression", "subscript_expression", "new_expression", {".": "field_expression", "->": "field_expression", "::": "qualified_identifier"}, {**dict.fromkeys("!~-+", "unary_expression"), "*": "pointer_expression", "&": "pointer_expression", "++": "update_expression", "--": "update_expression"})

#: Binary operators from the loosest to the tightest.
LEVELS = (("||",), ("&&",), ("|",), ("^",), ("&",), ("==", "!="), ("<", ">", "<=", ">=", "instanceof"), ("<<", ">>"), ("+", "-"), ("*", "/", "%"))
LEVEL = {op: k for k, ops in enumerate(LEVELS) for op in ops}
ASSIGN = frozenset("= += -= *= /= %= &= |= ^=".split())
OPERANDS = frozenset(
    "identifier this super number_literal string_literal character_literal char_literal parenthesized_expression binary_expression unary_expression update_expression pointer_expression instanceof_expression class_literal".split()
) | {x for n in (JAVA, CPP) for x in (n.call, n.index, n.creation, *n.marks.values())}
CLOSE = {"(": ")", "[": "]"}


def nested(items: Sequence[Node], says: Callable[[Node], str]) -> list[Node]:
    """Brackets with what they hold as nodes tagged by the opening one; those without a partner stay where they are."""
    stack: list[list[Node]] = [[]]
    for node in items:
        mark = "" if node.children else says(node)
        if mark in CLOSE:
            stack.append([node])
        elif mark in CLOSE.values() and len(stack) > 1 and CLOSE[says(stack[-1][0])] == mark:
            stack[-2].append(over(says(stack[-1][0]), [*stack.pop(), node]))
        else:
            stack[-1].append(node)
    while len(stack) > 1:
        rest = stack.pop()
        stack[-1] += rest
    return stack[0]


class Fold:
    def __init__(self, text: str, names: Names):
        self.text, self.names = text, names

    def says(self, node: Node) -> str:
        return self.text[node.start : node.end] if node.end - node.start <= 12 else ""

    def run(self, items: Sequence[Node]) -> list[Node]:
        """The expressions of a run of tokens."""
        return self.flat(nested(items, self.says))

    def flat(self, items: list[Node]) -> list[Node]:
        out: list[Node] = []
        at = 0
        while at < len(items):
            node, at = self.expression(items, at, 0)
            if at < len(items) and out[-1:] != [] and self.says(items[at]) in ASSIGN and node.tag == "identifier" and at + 1 < len(items) and self.names_a_type(out[-1]):
                value, end = self.expression(items, at + 1, 0)
                node, at = over("variable_declarator", [node, items[at], value]), end
            elif at + 1 < len(items) and self.says(items[at]) in ASSIGN and node.tag in OPERANDS:
                value, end = self.assigned(items, at + 1)
                node, at = over("assignment_expression", [node, items[at], value]), end
            out.append(node)
        return out

    def names_a_type(self, node: Node) -> bool:
        return node.tag in ("identifier", "generic_type", "qualified_identifier", "modifiers") or (not node.named and self.says(node).isalpha())

    def assigned(self, items: list[Node], at: int) -> tuple[Node, int]:
        parts = []
        while True:  # a chain of assignments groups from the right
            value, at = self.expression(items, at, 0)
            parts.append(value)
            if not (at + 1 < len(items) and value.tag in OPERANDS and self.says(items[at]) in ASSIGN):
                break
            parts.append(items[at])
            at += 1
        while len(parts) > 1:
            parts[-3:] = [over("assignment_expression", parts[-3:])]
        return parts[0], at

    def expression(self, items: list[Node], at: int, least: int) -> tuple[Node, int]:
        left, at = self.operand(items, at)
        same = None
        while left.tag in OPERANDS and at + 1 < len(items):
            op, width = self.says(items[at]), 1
            if op in ("<", ">") and self.says(items[at + 1]) == op and items[at].end == items[at + 1].start:
                op, width = op * 2, 2
            if op not in LEVEL or LEVEL[op] < least or items[at].children or at + width >= len(items):
                break
            right, end = self.expression(items, at + width, LEVEL[op] + 1)
            if right.tag not in OPERANDS and not (op == "instanceof" and (right.tag == "generic_type" or not right.named)):
                break
            tag = "instanceof_expression" if op == "instanceof" else "binary_expression"
            # A chain of one level is one node, however long: trees stay shallow.
            more = [*items[at : at + width], right]
            left, at, same = _longer(left, more) if same == (LEVEL[op], tag) else over(tag, [left, *more]), end, (LEVEL[op], tag)
        return left, at

    def operand(self, items: list[Node], at: int) -> tuple[Node, int]:
        node = items[at]
        prefix = self.names.prefix.get("" if node.children else self.says(node))
        if prefix and at + 1 < len(items):
            value, end = self.operand(items, at + 1)
            if value.tag in OPERANDS:
                return over(prefix, [node, value]), end
        if not node.children and self.says(node) == "new" and at + 1 < len(items):
            return self.creation(items, at)
        if node.tag in CLOSE and node.children:
            node = self.bracketed(node, "parenthesized_expression" if node.tag == "(" else "dimensions")
            return self.suffixes(node, items, at + 1)
        if node.tag == "identifier":
            end = self.generic(items, at)
            if end:
                return over("generic_type", items[at:end]), end
        return self.suffixes(node, items, at + 1) if node.tag in OPERANDS else (node, at + 1)

    def bracketed(self, node: Node, tag: str) -> Node:
        return over(tag, [node.children[0], *self.flat(node.children[1:-1]), node.children[-1]])

    def creation(self, items: list[Node], at: int) -> tuple[Node, int]:
        end = self.generic(items, at + 1) or at + 2
        while end + 1 < len(items) and self.says(items[end]) in (".", "::"):
            end = self.generic(items, end + 1) or end + 2
        parts = list(items[at:end])
        while end < len(items) and items[end].children and items[end].tag in CLOSE:
            parts.append(self.bracketed(items[end], "argument_list" if items[end].tag == "(" else "dimensions"))
            end += 1
        if end < len(items) and items[end].tag == "block":
            parts.append(items[end])
            end += 1
        return self.suffixes(over(self.names.creation, parts), items, end)

    def generic(self, items: list[Node], at: int) -> int:
        """Where a type with arguments that starts here ends; 0 if none does."""
        if at + 2 >= len(items) or items[at].tag != "identifier" or self.says(items[at + 1]) != "<":
            return 0
        depth = 0
        for k in range(at + 1, len(items)):
            said = self.says(items[k])
            depth += (said == "<") - (said == ">")
            if depth == 0:
                after = items[k + 1] if k + 1 < len(items) else None
                fits = after is None or after.tag in ("identifier", "(", "[", ")", ",") or self.says(after) in ("::", "&", "*", ">", ",", ")", "...")
                return k + 1 if fits else 0
            if not (said in ("<", ">", ",", ".", "?", "::", "*", "&") or items[k].tag == "identifier" or (items[k].tag == "[" and len(items[k].children) == 2) or (not items[k].named and said.isalpha())):
                return 0
        return 0

    def suffixes(self, node: Node, items: list[Node], at: int) -> tuple[Node, int]:
        """Calls, members, indices and counters that follow an operand."""
        while at < len(items):
            after = items[at]
            said = "" if after.children else self.says(after)
            if after.children and after.tag == "(" and node.tag in ("identifier", "this", "super", *self.names.marks.values()):
                inner = node.children if node.tag in self.names.marks.values() and self.names is JAVA else [node]
                node, at = over(self.names.call, [*inner, self.bracketed(after, "argument_list")]), at + 1
            elif after.children and after.tag == "[" and len(after.children) > 2 and node.tag != "dimensions":
                node, at = over(self.names.index, [node, after.children[0], *self.flat(after.children[1:-1]), after.children[-1]]), at + 1
            elif said in self.names.marks and at + 1 < len(items) and items[at + 1].tag in ("identifier", "this", "super", "class", "new"):
                tag = "class_literal" if items[at + 1].tag == "class" else self.names.marks[said]
                node, at = over(tag, [node, after, items[at + 1]]), at + 2
            elif said in ("++", "--"):
                node, at = over("update_expression", [node, after]), at + 1
            else:
                break
        return node, at
