"""Chat formatting: a small template language compiled to Python closures."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Strings that mean something to a model and must not come from a text.
CONTROL = ("<|im_start|>", "<|im_sep|>", "<|im_end|>", "<s>", "</s>", "[INST]", "[/INST]",
           "<<SYS>>", "<</SYS>>")
TEMPLATE = (
    "{% for m in messages %}<|im_start|>{{ m.role | escape }}<|im_sep|>"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}"
    "{% else %}{{ m.text | escape }}{% endif %}<|im_end|>{% endfor %}"
)
_CONTROL = re.compile("|".join(map(re.escape, sorted(CONTROL, key=len, reverse=True))))
_TURN = re.compile(r"<\|im_start\|>(.*?)<\|im_sep\|>(.*?)<\|im_end\|>", re.DOTALL)


def escape(text: str) -> str:
    """Double backslashes, and put one behind the first character of control strings."""
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    """The text that ``escape`` was given."""
    return re.sub(r"\\(\\?)", r"\1", text)


FILTERS: dict[str, Callable[[str], str]] = {
    "escape": escape, "trim": str.strip, "upper": str.upper, "lower": str.lower}

# Syntax tree: tuples whose first item names the node.
Node = tuple
_PIECE = re.compile(r"\{%\s*(.*?)\s*%\}|\{\{\s*(.*?)\s*\}\}", re.DOTALL)
_TOKEN = re.compile(r"\s*(?:('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(\d+)|([A-Za-z_]\w*)|(==|!=|[-+|.()\[\]]))")


class TemplateError(ValueError):
    """A template that does not follow the grammar."""


class _Expression:
    """Recursive descent over: or, and, not, == != in, +, filters, .name and ['name']."""

    def __init__(self, source: str):
        self.tokens, at = [], 0
        source = source.rstrip()
        while at < len(source):
            found = _TOKEN.match(source, at)
            if not found:
                raise TemplateError(f"cannot read {source[at:]!r}")
            kind = found.lastindex
            self.tokens.append(("text number name sign".split()[kind - 1], found[kind]))
            at = found.end()

    def parse(self) -> Node:
        tree = self._either()
        if self.tokens:
            raise TemplateError(f"unexpected {self.tokens[0][1]!r}")
        return tree

    def _take(self, *values: str) -> str | None:
        if self.tokens and self.tokens[0][0] != "text" and self.tokens[0][1] in values:
            return self.tokens.pop(0)[1]
        return None

    def _either(self) -> Node:
        left = self._both()
        while self._take("or"):
            left = ("or", left, self._both())
        return left

    def _both(self) -> Node:
        left = self._negated()
        while self._take("and"):
            left = ("and", left, self._negated())
        return left

    def _negated(self) -> Node:
        return ("not", self._negated()) if self._take("not") else self._compared()

    def _compared(self) -> Node:
        left = self._sum()
        while sign := self._take("==", "!=", "in"):
            left = (sign, left, self._sum())
        return left

    def _sum(self) -> Node:
        left = self._filtered()
        while self._take("+"):
            left = ("+", left, self._filtered())
        return left

    def _filtered(self) -> Node:
        left = self._item()
        while self._take("|"):
            name = self._name()
            if name not in FILTERS:
                raise TemplateError(f"unknown filter {name!r}")
            left = ("filter", left, name)
        return left

    def _item(self) -> Node:
        left = self._atom()
        while True:
            if self._take("."):
                left = ("field", left, self._name())
            elif self._take("["):
                kind, value = self.tokens.pop(0) if self.tokens else ("", "")
                if kind != "text" or not self._take("]"):
                    raise TemplateError("a field is named by a string")
                left = ("field", left, _string(value))
            else:
                return left

    def _atom(self) -> Node:
        if self._take("("):
            inner = self._either()
            if not self._take(")"):
                raise TemplateError("missing )")
            return inner
        if not self.tokens:
            raise TemplateError("an expression ends too early")
        kind, value = self.tokens.pop(0)
        if kind == "text":
            return ("value", _string(value))
        if kind == "number":
            return ("value", int(value))
        if kind == "name":
            fixed = {"true": True, "false": False, "none": None}
            return ("value", fixed[value]) if value in fixed else ("name", value)
        raise TemplateError(f"unexpected {value!r}")

    def _name(self) -> str:
        kind, value = self.tokens.pop(0) if self.tokens else ("", "")
        if kind != "name" or value.startswith("_"):
            raise TemplateError(f"{value!r} is not a field")
        return value


def _string(quoted: str) -> str:
    named = {"n": "\n", "t": "\t"}
    return re.sub(r"\\(.)", lambda m: named.get(m[1], m[1]), quoted[1:-1], flags=re.DOTALL)


def parse(template: str) -> Node:
    """Syntax tree of a template: text, output, for, if and generation nodes."""
    pieces, at = [], 0
    for found in _PIECE.finditer(template):
        pieces.append(("text", template[at:found.start()]))
        pieces.append(("tag", found[1]) if found[1] is not None else ("output", found[2]))
        at = found.end()
    pieces.append(("text", template[at:]))
    pieces.reverse()
    tree, stop = _block(pieces, ())
    assert stop is None
    return tree


def _block(pieces: list, ends: tuple[str, ...]) -> tuple[Node, str | None]:
    nodes = []
    while pieces:
        kind, body = pieces.pop()
        if kind == "text":
            nodes.append(("text", body))
            continue
        if kind == "output":
            nodes.append(("output", _Expression(body).parse()))
            continue
        word, _, rest = body.partition(" ")
        if word in ends:
            return ("block", *nodes), body
        if word == "for":
            made = re.fullmatch(r"([A-Za-z]\w*)\s+in\s+(.+)", rest, re.DOTALL)
            if not made:
                raise TemplateError(f"cannot read {body!r}")
            inner, _ = _block(pieces, ("endfor",))
            nodes.append(("for", made[1], _Expression(made[2]).parse(), inner))
        elif word == "if":
            nodes.append(_branch(rest, pieces))
        elif word == "generation":
            nodes.append(("generation", _block(pieces, ("endgeneration",))[0]))
        else:
            raise TemplateError(f"unexpected {body!r}")
    if ends:
        raise TemplateError(f"missing {ends[-1]}")
    return ("block", *nodes), None


def _branch(test: str, pieces: list) -> Node:
    yes, stop = _block(pieces, ("elif", "else", "endif"))
    word, _, rest = stop.partition(" ")
    if word == "elif":
        no: Node = ("block", _branch(rest, pieces))
    elif word == "else":
        no = _block(pieces, ("endif",))[0]
    else:
        no = ("block",)
    return ("if", _Expression(test).parse(), yes, no)


def fold(node: Node) -> Node:
    """The tree with constant expressions computed, dead branches cut and texts joined."""
    kind = node[0]
    if kind in ("value", "name", "text"):
        return node
    if kind == "block":
        flat: list[Node] = []
        for child in map(fold, node[1:]):
            for item in child[1:] if child[0] == "block" else (child,):
                if item[0] == "text" and flat and flat[-1][0] == "text":
                    flat[-1] = ("text", flat[-1][1] + item[1])
                elif item != ("text", ""):
                    flat.append(item)
        return ("block", *flat)
    if kind == "output":
        inner = fold(node[1])
        return ("text", _shown(inner[1])) if inner[0] == "value" else ("output", inner)
    if kind == "if":
        test, yes, no = map(fold, node[1:])
        if test[0] == "value":
            return yes if test[1] else no
        return ("if", test, yes, no)
    if kind == "for":
        return ("for", node[1], fold(node[2]), fold(node[3]))
    if kind == "generation":
        return ("generation", fold(node[1]))
    parts = tuple(fold(p) if isinstance(p, tuple) else p for p in node[1:])
    if all(p[0] == "value" for p in parts if isinstance(p, tuple)):
        return ("value", _evaluate((kind, *parts))({}))
    return (kind, *parts)


def _shown(value) -> str:
    return "" if value is None else str(value)


def _evaluate(node: Node) -> Callable[[dict], object]:
    """Closure that computes an expression from the variables in scope."""
    kind = node[0]
    if kind == "value":
        return lambda scope, v=node[1]: v
    if kind == "name":
        return lambda scope, n=node[1]: scope.get(n)
    left = _evaluate(node[1])
    if kind == "field":
        def field(scope, name=node[2]):
            owner = left(scope)
            # Plain dictionaries only: attributes of Python objects stay out of reach.
            return owner.get(name) if isinstance(owner, dict) else None
        return field
    if kind == "filter":
        apply = FILTERS[node[2]]
        return lambda scope: apply(_shown(left(scope)))
    if kind == "not":
        return lambda scope: not left(scope)
    right = _evaluate(node[2])
    if kind == "and":
        return lambda scope: left(scope) and right(scope)
    if kind == "or":
        return lambda scope: left(scope) or right(scope)
    if kind == "==":
        return lambda scope: left(scope) == right(scope)
    if kind == "!=":
        return lambda scope: left(scope) != right(scope)
    if kind == "in":
        return lambda scope: _shown(left(scope)) in (right(scope) or "")
    return lambda scope: _shown(left(scope)) + _shown(right(scope))


Writer = Callable[[dict, list, list], None]


def _generate(node: Node) -> Writer:
    """Closure that appends what a node renders, and marks generated parts by index."""
    kind = node[0]
    if kind == "text":
        return lambda scope, out, marks: out.append(node[1])
    if kind == "output":
        value = _evaluate(node[1])
        return lambda scope, out, marks: out.append(_shown(value(scope)))
    if kind == "block":
        parts = [_generate(n) for n in node[1:]]

        def block(scope, out, marks):
            for part in parts:
                part(scope, out, marks)
        return block
    if kind == "if":
        test, yes, no = _evaluate(node[1]), _generate(node[2]), _generate(node[3])
        return lambda scope, out, marks: (yes if test(scope) else no)(scope, out, marks)
    if kind == "for":
        items, body = _evaluate(node[2]), _generate(node[3])

        def loop(scope, out, marks, name=node[1]):
            listed = items(scope) or []
            for i, item in enumerate(listed):
                state = {"index": i + 1, "first": i == 0, "last": i == len(listed) - 1}
                body({**scope, name: item, "loop": state}, out, marks)
        return loop
    inner = _generate(node[1])

    def generation(scope, out, marks):
        start = len(out)
        inner(scope, out, marks)
        marks.append((start, len(out)))
    return generation


def compile_template(template: str = TEMPLATE) -> Callable[[list[dict]], tuple[str, list]]:
    """Function from messages to the text and the (start, end) spans of generated parts."""
    write = _generate(fold(parse(template)))

    def render(messages: list[dict]) -> tuple[str, list[tuple[int, int]]]:
        out: list[str] = []
        marks: list[tuple[int, int]] = []
        write({"messages": messages}, out, marks)
        ends = [0]
        for part in out:
            ends.append(ends[-1] + len(part))
        return "".join(out), [(ends[a], ends[b]) for a, b in marks]

    return render


class _Alone:
    """The key of a turn without a conversation; equal to no other."""


def format_chats(rows: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """(conv_id, n_turns, formatted, loss_spans), one row per conversation.

    ``rows`` has conv_id, turn, role and text.  Turns follow their number (null last), then role and
    text; repeated turns stay.  A null text or role is empty, each row with a null
    conv_id is a conversation of one turn.  Spans are in code points of ``formatted``.  Rows are
    dealt by conversation and read in order, so a task holds one conversation at a time; those with a
    null conv_id are not dealt.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    columns = rows.select("conv_id", "turn", "role", "text")
    ordered = columns.where("conv_id IS NOT NULL").repartition(
        parts, "conv_id").sortWithinPartitions(
        "conv_id", F.col("turn").asc_nulls_last(), "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compile_template(template)

        def turns():
            for batch in batches:
                yield from zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")))

        held: list[tuple] = []
        size = 0
        for conv_id, group in groupby(turns(), key=lambda t: _Alone() if t[0] is None else t[0]):
            if isinstance(conv_id, _Alone):
                conv_id = None
            messages = [{"role": r or "", "text": t or ""} for _, r, t in group]
            text, spans = render(messages)
            held.append((conv_id, len(messages), text,
                         [{"start": a, "end": b} for a, b in spans]))
            size += len(text)
            if len(held) >= 5_000 or size > 1 << 24:
                yield _batch(held)
                held, size = [], 0
        yield _batch(held)

    schema = ("conv_id long, n_turns long, formatted string, "
              "loss_spans array<struct<start:long,end:long>>")
    return ordered.mapInArrow(run, schema).unionByName(
        columns.where("conv_id IS NULL").mapInArrow(run, schema))


_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_SCHEMA = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()),
                     ("formatted", pa.string()), ("loss_spans", _SPAN)])


def _batch(rows: list[tuple], schema: pa.Schema = _SCHEMA) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)


def read_back(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn in a conversation that the default template rendered."""
    return [(unescape(role), unescape(text)) for role, text in _TURN.findall(formatted)]


def digests(chats: DataFrame) -> DataFrame:
    """Digest columns of formatted conversations, read back from the text and its spans."""
    schema = pa.schema([
        ("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
        ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def one(conv_id, formatted: str, spans: list[dict]) -> tuple:
        turns = read_back(formatted)
        whole, loss, chars = hashlib.sha256(), hashlib.sha256(), 0
        for role, text in turns:
            whole.update(f"{role}\n{text}\n".encode())
        for span in spans:
            part = unescape(formatted[span["start"]:span["end"]])
            loss.update(part.encode())
            chars += len(part)
        return (conv_id, len(turns), whole.hexdigest(), chars, loss.hexdigest(), len(formatted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _batch([one(*row) for row in zip(*(
                batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss_spans")))],
                schema)

    return chats.mapInArrow(
        run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, "
             "loss_sha256 string, formatted_chars long")
