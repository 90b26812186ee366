"""Syntax trees as node tables.

A parser of our own covers packages, imports, classes, methods, parameters, statements, expressions and comments
of Java, and namespaces, classes, functions, statements, expressions and directives of C++; pages are parsed by the
standard library.  Other constructs are flat tokens, so trees need not equal those of a full grammar node for node.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .expressions import CPP, JAVA, Fold, Node, nested, over

LEXER = re.compile(
    r"""(?P<space>\s+)|(?P<line_comment>//[^\n]*)|(?P<block_comment>/\*.*?(?:\*/|\Z))|(?P<string_literal>"(?:\\.|[^"\\\n])*"?)|(?P<character_literal>'(?:\\.|[^'\\\n])*'?)
    |(?P<number_literal>\d[\w.]*)|(?P<identifier>[^\W\d][\w$]*|\$[\w$]*)|(?P<mark>\.\.\.|->|::|[<>=!+\-*/%&|^]=|&&|\|\||\+\+|--|.)""",
    re.VERBOSE | re.DOTALL,
)
MODIFIERS = frozenset("public protected private static final abstract native synchronized transient volatile strictfp default sealed".split())
KEYWORDS = MODIFIERS | frozenset("package import class interface enum extends implements throws return if else for while do switch case break continue new try catch finally throw void int long short byte char boolean float double this super".split())
CPP_KEYWORDS = KEYWORDS - frozenset("package import extends implements throws interface finally boolean byte".split()) | frozenset("const constexpr struct union namespace template typename typedef using unsigned signed inline virtual explicit friend mutable operator sizeof delete auto goto noexcept override extern".split())
#: Statements by their first word.
STATEMENTS = {x: f"{x}_statement" for x in "if for while do switch try return throw break continue synchronized goto".split()}


@dataclass
class _Token:
    kind: str
    text: str
    start: int
    end: int

    def node(self, keywords: frozenset[str] = KEYWORDS) -> Node:
        plain = self.kind == "mark" or self.text in keywords
        return Node(self.text if plain else self.kind, self.start, self.end, not plain)


def lex(text: str) -> list[_Token]:
    return [_Token(m.lastgroup, m.group(), m.start(), m.end()) for m in LEXER.finditer(text) if m.lastgroup != "space"]


class _Java:
    """Recursive descent that never fails: what it does not know becomes tokens."""

    def __init__(self, text: str):
        self.text, self.tokens, self.at = text, lex(text), 0

    def peek(self, k: int = 0) -> str:
        return self.tokens[self.at + k].text if self.at + k < len(self.tokens) else ""

    def kind(self, k: int = 0) -> str:
        return self.tokens[self.at + k].kind if self.at + k < len(self.tokens) else ""

    def take(self) -> Node:
        self.at += 1
        return self.tokens[self.at - 1].node()

    def close(self, node: Node) -> Node:
        if node.children:
            node.start, node.end = node.children[0].start, node.children[-1].end
        return node

    def program(self) -> Node:
        root = Node("program", 0, len(self.text))
        while self.at < len(self.tokens):
            root.children.append(self.member(""))
        return root

    def until(self, tag: str, stop: str = ";") -> Node:
        node = Node(tag)
        while self.at < len(self.tokens):
            node.children.append(self.take())
            if self.tokens[self.at - 1].text == stop:
                break
        return self.close(node)

    def name(self) -> Node:
        """identifier, or scoped_identifier nested to the left as in ``a.b.c``."""
        node = self.take()
        while self.peek() == "." and self.kind(1) == "identifier":
            node = self.close(Node("scoped_identifier", children=[node, self.take(), self.take()]))
        return node

    def declared(self, tag: str) -> Node:
        node = Node(tag, children=[self.take()])
        if self.kind() == "identifier":
            node.children.append(self.name())
        node.children += self.until(tag).children
        return self.close(node)

    def modifiers(self) -> list[Node]:
        node = Node("modifiers")
        while self.peek() in MODIFIERS or (self.peek() == "@" and self.kind(1) == "identifier" and self.peek(1) != "interface"):
            if self.peek() == "@":
                mark = Node("annotation", children=[self.take(), self.name()])
                if self.peek() == "(":
                    mark.children.append(self.group("(", ")", "annotation_argument_list"))
                node.children.append(self.close(mark))
            else:
                node.children.append(self.take())
        return [self.close(node)] if node.children else []

    def group(self, opening: str, closing: str, tag: str) -> Node:
        node, depth = Node(tag), 0
        while self.at < len(self.tokens):
            depth += (self.peek() == opening) - (self.peek() == closing)
            node.children.append(self.take())
            if depth == 0:
                break
        return self.close(node)

    def member(self, around: str) -> Node:
        if self.kind() in ("line_comment", "block_comment"):
            return self.take()
        if self.peek() == "package":
            return self.declared("package_declaration")
        if self.peek() == "import":
            return self.until("import_declaration")
        begin = self.at
        found = self.modifiers()
        if self.peek() in ("class", "interface", "enum"):
            return self.type_declaration(found)
        at = self.at
        while at < len(self.tokens) and self.tokens[at].text not in "({};=":
            at += 1
        here = self.tokens[at].text if at < len(self.tokens) else ""
        if here == "(" and at > self.at and self.tokens[at - 1].kind == "identifier" and self.tokens[at - 1].text not in KEYWORDS:
            return self.method(found, at - 1, around)
        if self.at == begin and here in ("", "}", ")"):
            return self.take()
        return self.field(found)

    def type_declaration(self, found: list[Node]) -> Node:
        kind = {"class": "class", "interface": "interface", "enum": "enum"}[self.peek()]
        node = Node(f"{kind}_declaration", children=[*found, self.take()])
        name = self.peek()
        if self.kind() == "identifier":
            node.children.append(self.take())
        while self.at < len(self.tokens) and self.peek() not in ("{", ";"):
            node.children.append(self.take())
        if self.peek() == "{":
            body = Node(f"{kind}_body", children=[self.take()])
            while self.at < len(self.tokens) and self.peek() != "}":
                body.children.append(self.member(name))
            if self.peek() == "}":
                body.children.append(self.take())
            node.children.append(self.close(body))
        return self.close(node)

    def method(self, found: list[Node], name_at: int, around: str) -> Node:
        kind = "constructor_declaration" if name_at == self.at and self.tokens[name_at].text == around else "method_declaration"
        node = Node(kind, children=found)
        if self.at < name_at:
            node.children.append(self.type_until(name_at))
        node.children += [self.take(), self.parameters()]
        while self.at < len(self.tokens) and self.peek() not in ("{", ";", "}"):
            node.children.append(self.take())
        if self.peek() == "{":
            node.children.append(self.block())
        elif self.peek() == ";":
            node.children.append(self.take())
        return self.close(node)

    def type_until(self, at: int) -> Node:
        parts = []
        while self.at < at:
            parts.append(self.take())
        if len(parts) == 1:
            parts[0].tag = "type_identifier" if parts[0].tag == "identifier" else parts[0].tag
            return parts[0]
        return self.close(Node("generic_type", children=parts))

    def parameters(self) -> Node:
        node = Node("formal_parameters", children=[self.take()])
        while self.at < len(self.tokens) and self.peek() != ")":
            if self.peek() == ",":
                node.children.append(self.take())
                continue
            found, at, depth = self.modifiers(), self.at, 0
            while at < len(self.tokens) and not (depth == 0 and self.tokens[at].text in (",", ")")):
                depth += (self.tokens[at].text in "<([") - (self.tokens[at].text in ">)]")
                at += 1
            spread = any(t.text == "..." for t in self.tokens[self.at : at])
            children = [*found]
            if self.at < at - 1:
                children.append(self.type_until(at - 1))
            if self.at < at:
                children.append(self.take())
            if not children:
                break
            node.children.append(self.close(Node("spread_parameter" if spread else "formal_parameter", children=children)))
        if self.peek() == ")":
            node.children.append(self.take())
        return self.close(node)

    def block(self) -> Node:
        """Statements in braces; a statement ends at a semicolon or with a block, but not within brackets."""
        node = Node("block", children=[self.take()])
        while self.at < len(self.tokens) and self.peek() != "}":
            if self.kind() in ("line_comment", "block_comment"):
                node.children.append(self.take())
                continue
            parts = self.statement()
            first = self.text[parts[0].start : parts[0].end] if not parts[0].children else ""
            node.children.append(over(STATEMENTS.get(first, "statement"), self.folded(parts)))
        if self.peek() == "}":
            node.children.append(self.take())
        return self.close(node)

    def statement(self) -> list[Node]:
        parts: list[Node] = []
        depth = 0
        while self.at < len(self.tokens) and self.peek() != "}":
            said = self.peek()
            depth += (said in ("(", "[")) - (said in (")", "]"))
            values = said == "{" and bool(parts) and self.tokens[self.at - 1].text in ("=", "]", ",")
            part = self.block() if said == "{" else self.take()
            parts.append(part)
            if depth <= 0 and (part.tag == ";" or (part.tag == "block" and not values and self.peek() not in ("else", "catch", "finally"))):
                break
        return parts

    def folded(self, parts: list[Node]) -> list[Node]:
        """The expressions of a statement, and what a ``catch`` declares."""
        fold = Fold(self.text, JAVA)
        items = nested(parts, fold.says)
        for k in range(1, len(items)):
            inner = items[k].children[1:-1]
            if items[k].tag == "(" and items[k - 1].tag == "catch" and inner:
                items[k] = over("catch_clause_head", [items[k].children[0], over("catch_formal_parameter", inner), items[k].children[-1]])
        return fold.flat(items)

    def field(self, found: list[Node]) -> Node:
        node = Node("field_declaration", children=found)
        node.children += self.folded(self.statement())
        if not node.children:
            return self.take()
        return self.close(node)


def parse_java(text: str) -> Node:
    return _Java(text).program()


def parse_cpp(text: str) -> Node:
    """Namespaces, classes, functions and statements below nested braces; a directive is one leaf."""
    root = Node("translation_unit", 0, len(text))
    stack = [root]
    skip = 0
    for start, end in [*((m.start(), m.end()) for m in re.finditer(r"(?m)^[ \t]*#(?:\\\n|[^\n])*", text)), (len(text), None)]:
        for t in lex(text[max(skip, 0) : start]):
            node = t.node(CPP_KEYWORDS)
            _brace(stack, Node(node.tag, t.start + skip, t.end + skip, node.named))
        if end is not None:
            stack[-1].children.append(Node("preproc_directive", start, end))
            skip = end
    while len(stack) > 1:
        _closed(stack)
    root.children = _statements(root.children, text, False)
    return root


def _brace(stack: list[Node], node: Node) -> None:
    node.tag = {"line_comment": "comment", "block_comment": "comment", "character_literal": "char_literal"}.get(node.tag, node.tag)
    if node.tag == "{":
        stack.append(Node("compound_statement", node.start, node.end))
    stack[-1].children.append(node)
    if node.tag == "}" and len(stack) > 1:
        _closed(stack)


def _closed(stack: list[Node]) -> None:
    done = stack.pop()
    done.end = done.children[-1].end
    stack[-1].children.append(done)


BODIES = {"class": ("class_specifier", "field_declaration_list"), "struct": ("struct_specifier", "field_declaration_list"), "union": ("union_specifier", "field_declaration_list"), "enum": ("enum_specifier", "enumerator_list"), "namespace": ("namespace_definition", "declaration_list")}


def _statements(children: list[Node], text: str, inside: bool) -> list[Node]:
    """What stands between braces, cut at semicolons and blocks; ``inside`` a function, or not."""
    fold = Fold(text, CPP)
    out: list[Node] = []
    run: list[Node] = []
    depth = 0
    for k, node in enumerate(children):
        if not run and (node.tag in ("comment", "preproc_directive", ";") or (node.tag in "{}" and not node.children)):
            out.append(node)
            continue
        depth += (node.tag in ("(", "[")) - (node.tag in (")", "]"))
        values = node.tag == "compound_statement" and bool(run) and run[-1].tag in ("=", ",", "]", "return")
        run.append(node)
        if len(run) == 2 and node.tag == ":" and run[0].tag in ("public", "private", "protected"):
            out.append(over("access_specifier", run))
            run = []
            continue
        goes_on = k + 1 < len(children) and children[k + 1].tag in ("else", "catch")
        if k + 1 == len(children) or children[k + 1].tag == "}" or (depth <= 0 and (node.tag == ";" or (node.tag == "compound_statement" and not values and not goes_on))):
            out.append(_statement(run, fold, inside))
            run, depth = [], 0
    return out


def _statement(run: list[Node], fold: Fold, inside: bool) -> Node:
    body = run[-1] if run[-1].tag == "compound_statement" else None
    kind = next((BODIES[n.tag] for n in run if n.tag in BODIES and not n.children), None) if not any(n.tag == "(" for n in run) else None
    calls = nested(run, fold.says)
    at = next((k for k in range(1, len(calls)) if calls[k].tag == "(" and calls[k].children and (calls[k - 1].tag == "identifier" or fold.says(calls[k - 1]) not in STATEMENTS)), 0)
    function = body is not None and kind is None and not inside and at > 0
    for node in run:
        if node.tag == "compound_statement":
            node.children = _statements(node.children, fold.text, inside or kind is None)
    if kind and body:
        body.tag = kind[1]
        return over(kind[0], run)
    if function:
        begin = at - 1
        while begin >= 2 and calls[begin - 1].tag in ("::", "~"):
            begin -= 2 if calls[begin - 1].tag == "::" else 1
        head = over("function_declarator", [*calls[begin:at], over("parameter_list", calls[at].children)])
        return over("function_definition", [*calls[:begin], head, *fold.flat(calls[at + 1 :])])
    return over(STATEMENTS.get(run[0].tag, "statement"), fold.flat(calls))


class _Page(HTMLParser):
    EMPTY = frozenset("area base br col embed hr img input link meta source track wbr".split())

    def __init__(self, text: str):
        super().__init__(convert_charrefs=False)
        self.lines = [0, *(m.end() for m in re.finditer("\n", text))]
        self.root = Node("document", 0, len(text))
        self.stack = [self.root]
        self.size = len(text)
        self.feed(text)
        self.close()

    def place(self) -> int:
        line, col = self.getpos()
        return self.lines[line - 1] + col

    def handle_starttag(self, tag, attrs):
        at = self.place()
        node = Node(tag, at, at + len(self.get_starttag_text() or ""))
        self.stack[-1].children.append(node)
        if tag not in self.EMPTY:
            self.stack.append(node)

    def handle_startendtag(self, tag, attrs):
        at = self.place()
        self.stack[-1].children.append(Node(tag, at, at + len(self.get_starttag_text() or "")))

    def handle_endtag(self, tag):
        if any(n.tag == tag for n in self.stack[1:]):
            while len(self.stack) > 1:
                node = self.stack.pop()
                node.end = max(node.end, self.place())
                if node.tag == tag:
                    break

    def handle_data(self, data):
        if data.strip():
            at = self.place()
            self.stack[-1].children.append(Node("text", at, at + len(data)))


def parse_html(text: str) -> Node:
    """Elements and texts; end tags without a start are ignored, open elements end with the page."""
    return _Page(text).root


#: Inner nodes that keep their text, since names are made of it.
SPELLED = ("generic_type", "scoped_identifier")
PARSERS = {"java": parse_java, "cpp": parse_cpp, "html": parse_html}
COLUMNS = "node_id int, parent_id int, end_id int, depth int, tag string, text string, is_named boolean, is_leaf boolean, ancestors array<int>, start_line int, start_col int, end_line int, end_col int, subtree_hash long"


def rows(root: Node, text: str, atomic: frozenset[str]) -> list[tuple]:
    """The node table of a tree in pre-order; nodes with an atomic tag are leaves with all their text.

    Lines and byte columns count from 0.  The hash covers tag and text of a leaf, tag and children's hashes of
    another node, and is never 0.
    """
    starts = [0, *(m.end() for m in re.finditer("\n", text))]

    def point(at: int) -> tuple[int, int]:
        from bisect import bisect_right

        line = bisect_right(starts, at) - 1
        return line, len(text[starts[line] : at].encode())

    out: list[list] = []
    # An explicit stack: (node, ancestors, None) opens a node, (number, child numbers) closes it.
    todo: list[tuple] = [(root, [])]
    kids: dict[int, list[int]] = {}
    while todo:
        item = todo.pop()
        if isinstance(item[0], int):
            k = item[0]
            digest = hashlib.blake2b("\x01".join([out[k][4], *(str(out[c][13]) for c in kids[k])] if kids[k] else [out[k][4], "\x02", out[k][5]]).encode(), digest_size=8).digest()
            out[k][13] = int.from_bytes(digest, "big", signed=True) or 1
            out[k][2] = len(out) - 1
            continue
        node, above = item
        k = len(out)
        children = [] if node.tag in atomic else node.children
        own = text[node.start : node.end] if not children or node.tag in SPELLED else None
        out.append([k, above[-1] if above else None, k, len(above), node.tag, own, node.named, not children, above, *point(node.start), *point(node.end), 0])
        kids[k] = []
        if above:
            kids[above[-1]].append(k)
        todo.append((k,))
        todo += [(c, [*above, k]) for c in reversed(children)]
    return [tuple(r) for r in out]


def parse(text: str, language: str, atomic: frozenset[str] = frozenset()) -> list[tuple]:
    if language not in PARSERS:
        raise ValueError(f"unknown language {language}")
    return rows(PARSERS[language](text), text, atomic)


def parse_contents(contents: DataFrame, language: str, atomic: list[str] | tuple[str, ...] = (), id_col: str = "content_id", content_col: str = "content") -> tuple[DataFrame, DataFrame]:
    """The node table of distinct contents, and (content_id, error) of those that could not be parsed.

    Each distinct id is parsed once.  A null content counts as empty and is one leaf, the root.
    """
    kind = dict(contents.dtypes)[id_col]
    tags = frozenset(atomic)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [id_col, *(c.split()[0] for c in COLUMNS.split(", ")), "error"]
        for batch in batches:
            for key, content in batch.itertuples(index=False):
                try:
                    text = "" if content is None else content if isinstance(content, str) else bytes(content).decode("utf-8", "replace")
                    found = [(key, *r, None) for r in parse(text, language, tags)]
                except Exception as e:  # whatever is wrong with one file is told of it
                    found = [(key, *[None] * (len(names) - 2), repr(e))]
                table = pd.DataFrame(found, columns=names)
                for c in ("parent_id", "node_id", "end_id", "depth", "start_line", "start_col", "end_line", "end_col"):
                    table[c] = table[c].astype("Int32")
                yield table

    each = contents.select(id_col, content_col).dropDuplicates([id_col])
    found = each.mapInPandas(run, f"{id_col} {kind}, {COLUMNS}, error string")
    return found.filter(F.col("error").isNull()).drop("error"), found.filter(F.col("error").isNotNull()).select(id_col, "error")


def variants_of(files: DataFrame, nodes: DataFrame) -> DataFrame:
    """What :func:`plyweave.operators.align.align` takes: each file's leaves with keys, and its inner nodes as ancestors."""
    leaves = nodes.filter("is_leaf")
    own = leaves.select("content_id", "node_id", "text", F.concat_ws("\x01", "tag", F.coalesce("text", F.lit(""))).alias("key"), "ancestors")
    below = own.select("content_id", "key", F.explode("ancestors").alias("node_id")).groupBy("content_id", "node_id").agg(F.sort_array(F.collect_set("key")).alias("leaves"))
    inner = nodes.filter("NOT is_leaf").select("content_id", "node_id", "tag", F.col("subtree_hash").cast("string").alias("digest"))
    subtrees = inner.join(below, ["content_id", "node_id"]).groupBy("content_id").agg(F.sort_array(F.collect_list(F.struct("node_id", "tag", "digest", "leaves"))).alias("s"))
    tokens = own.groupBy("content_id").agg(F.sort_array(F.collect_list(F.struct("node_id", "text", "key", F.reverse("ancestors").alias("chain")))).alias("t"))
    joined = tokens.join(subtrees, "content_id", "left").withColumn("s", F.coalesce("s", F.array().cast(dict(subtrees.dtypes)["s"])))
    ids = F.transform("s", lambda x: x.node_id)
    chains = F.transform("t", lambda x: F.transform(x.chain, lambda a: F.array_position(ids, a).cast("int") - 1))
    shaped = joined.select(
        "content_id", F.transform("t", lambda x: F.coalesce(x.text, F.lit(""))).alias("tokens"), F.transform("t", lambda x: x.key).alias("keys"),
        F.transform("s", lambda x: F.struct(x.tag.alias("tag"), x.digest.alias("digest"), x.leaves.alias("leaves"))).alias("subtrees"), chains.alias("chains"),
    )
    return files.select("family", "variant", "variant_idx", "path", "content_id").join(shaped, "content_id")
