"""Chat formatting: heterogeneous JSON records to canonical turns, marked-up text and loss spans.

A record's fingerprint is the hash of all its nested field paths, as all elements of its lists have them. Each distinct
fingerprint is resolved once against the layouts, declarative mappings of paths to turns: the first layout whose required paths are
there and that leaves no path out that is known to speak. The resolved mappings are a table by fingerprint, and records take
theirs from it. What no mapping gives whole has none, and a reason. Everything is DataFrame functions.

Template: each turn is ``<|im_start|>role\\ntext<|im_end|>\\n``. Control strings inside texts and roles are
escaped by a backslash after their first character, which is undone exactly: a place that already reads like an
escaped control string gets one backslash more.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import table

START, END = "<|im_start|>", "<|im_end|>\n"
# First characters, then the rests, of the control strings of common chat templates: <s> </s> <<SYS>> <</SYS>> [INST] [/INST] <|name|>
CONTROL_FIRST = r"([<\[])"
CONTROL_REST = r"(/?s>|</?SYS>>|/?INST\]|\|[A-Za-z_]+\|>)"
TURN = "struct<role:string,text:string>"
TURNS = f"array<{TURN}>"


@dataclass(frozen=True)
class Part:
    """Some turns of a record, by kind.

    text: one turn of the first role, from ``fields``: of each the first name that the record has, joined by an empty line.
    list: a turn for each element of the list at ``path``: its role by the first of the names ``roles`` that it has, its text by
    the first of ``fields[0]``. pairs: several turns for each element, a role with the names of its text. tuples: elements that
    are lists of texts of the roles in turn, or texts of the roles in turn. ``beside``: left out if a list says the
    same; ``aside``: not a turn, but given beside the turns (the answer that was not chosen, say).
    """

    kind: str
    path: str
    roles: tuple[str, ...]
    fields: tuple[tuple[str, ...], ...] = ()
    needed: bool = True
    beside: bool = False
    aside: bool = False
    exact: bool = False  # of a list: some elements have the first role name and some the first text name


@dataclass(frozen=True)
class Layout:
    name: str
    parts: tuple[Part, ...]

    @property
    def paths(self) -> tuple[str, ...]:
        """What a record must have to be of this layout, by the names that come first."""
        out: list[str] = []
        for p in self.parts:
            if p.needed:
                top = {"text": "", "list": f"{p.path}[].", "pairs": f"{p.path}[]."}.get(p.kind)
                names = [p.roles[0], p.fields[0][0]] if p.kind == "list" else [f[0] for f in (p.fields[:1] if p.kind == "text" else p.fields)]
                out += [f"{p.path}[][]"] if top is None else [top + x for x in names]
        return tuple(out)


#: Lists of messages; fields of a message; fields of single turns. All in order of priority, lists before single turns.
LISTS = ("messages", "conversations", "turns", "conversation", "dialog", "dialogue", "chat", "data.messages", "data.conversations")
ROLE_FIELDS, TEXT_FIELDS = ("role", "from", "speaker"), ("content", "value", "text", "parts")
USER_FIELDS = ("instruction", "prompt", "question", "query", "human", "user", "input")
ASSISTANT_FIELDS = ("output", "response", "completion", "answer", "assistant", "gpt", "bot")
#: Those of them that may stand beside a list.
BESIDE_USER, BESIDE_ASSISTANT = ("instruction", "prompt", "question"), ("output", "response", "completion", "answer")
#: Text of a system turn before all others, and what follows a single user turn after an empty line.
SYSTEM_FIELDS, INPUT_FIELD = ("system", "system_prompt"), "input"
NAMED = {("messages", "role", "content"): "messages", ("conversations", "from", "value"): "from_value", ("turns", "role", "text"): "role_text", ("instruction", "output"): "instruction"}

SYSTEM = Part("text", "", ("system",), (SYSTEM_FIELDS,), needed=False, beside=True)
_ASKED = Part("text", "", ("user",), (BESIDE_USER,), needed=False, beside=True)
_ANSWERED = Part("text", "", ("assistant",), (BESIDE_ASSISTANT,), needed=False, beside=True)


def messages(path: str, role: str | None = None, text: str | None = None, *, needed: bool = True, aside: bool = False) -> Part:
    """A list of messages; where the two names are given, elements that lack them may have the others."""
    exact, role, text = role is not None, role or ROLE_FIELDS[0], text or TEXT_FIELDS[0]
    first = lambda x, names: (x, *[n for n in names if n != x])
    return Part("list", path, first(role, ROLE_FIELDS), (first(text, TEXT_FIELDS),), needed=needed, aside=aside, exact=exact)


def said_pairs(path: str, *, needed: bool = True) -> Part:
    return Part("pairs", path, ("user", "assistant"), (USER_FIELDS, ASSISTANT_FIELDS), needed=needed)


#: What was said before a single user turn, in any of three forms.
HISTORY = (messages("history", needed=False), said_pairs("history", needed=False), Part("tuples", "history", ("user", "assistant"), needed=False))


def single(user: str, assistant: str) -> tuple[Part, ...]:
    asked = ((user,), (INPUT_FIELD,)) if user != INPUT_FIELD else ((user,),)
    return (SYSTEM, *HISTORY, Part("text", "", ("user",), asked), Part("text", "", ("assistant",), ((assistant,),)))


LAYOUTS = (
    *[Layout(NAMED.get((x, r, t), f"{x.replace('.', '_')}_{r}_{t}"), (SYSTEM, _ASKED, messages(x, r, t), _ANSWERED)) for x in LISTS for r in ROLE_FIELDS for t in TEXT_FIELDS],
    Layout("prompt_completion_messages", (SYSTEM, messages("prompt"), messages("completion"))),
    Layout("prompt_response_messages", (SYSTEM, messages("prompt"), messages("response"))),
    Layout("preference_prompt_messages", (SYSTEM, messages("prompt"), messages("chosen"), messages("rejected", needed=False, aside=True))),
    Layout("preference_messages", (SYSTEM, _ASKED, messages("chosen"), messages("rejected", needed=False, aside=True))),
    Layout("preference", (SYSTEM, *HISTORY, Part("text", "", ("user",), (USER_FIELDS,)), Part("text", "", ("assistant",), (("chosen",),)), Part("text", "", ("rejected",), (("rejected",),), needed=False, aside=True))),
    *[Layout(f"{x.replace('.', '_')}_pairs", (SYSTEM, said_pairs(x))) for x in (*LISTS, "history")],
    *[Layout(f"{x}_tuples", (SYSTEM, Part("tuples", x, ("user", "assistant")))) for x in ("conversations", "conversation", "turns", "history")],
    *[Layout(NAMED.get((u, a), f"{u}_{a}"), single(u, a)) for u in USER_FIELDS for a in ASSISTANT_FIELDS],
)
# Names that layouts give to the three roles, where the role's field is not called role.
ROLE_NAMES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
#: Of a variant's schema: field names, openings, closings and types of values.
SCHEMA_TOKEN = r"(?:`[^`]*+(?:``[^`]*+)*+`|[A-Za-z0-9_]+): |OBJECT<|ARRAY<|>|[A-Z_]+(?:\(\d+,\d+\))?"
PART = "struct<kind:string,path:string,roles:array<string>,fields:array<array<string>>,needed:boolean,beside:boolean,aside:boolean,exact:boolean>"
SAID = f"struct<beside:boolean,aside:boolean,listed:boolean,turns:{TURNS}>"
#: Of records that are no variant: strings of any length.
ANY_LENGTH = {"maxStringLen": str(2**31 - 1)}


def field_paths(parsed: Column) -> Column:
    """All nested field paths of a variant, sorted: ``a.b``, and ``a[].b`` in lists, of all elements together. Null for null.

    A list that holds both objects and other values counts as a list of values without fields.
    """
    tokens = F.regexp_extract_all(F.schema_of_variant(parsed), F.lit(SCHEMA_TOKEN), F.lit(0))
    kind = "struct<open:array<string>,name:string,paths:array<string>>"
    start = F.struct(F.array(F.lit("")).alias("open"), F.lit("").alias("name"), F.array().cast("array<string>").alias("paths")).cast(kind)

    def step(acc: Column, token: Column) -> Column:
        here = F.concat(F.element_at(acc["open"], -1), acc["name"])
        inner = F.when(token == "ARRAY<", F.concat(here, F.lit("[]"))).when(here == "", here).otherwise(F.concat(here, F.lit(".")))
        seen = F.array_append(acc["paths"], here)
        same = lambda open, name, paths: F.struct(open.alias("open"), name.alias("name"), paths.alias("paths")).cast(kind)
        return (
            F.when(token.endswith(": "), same(acc["open"], F.substring(token, F.lit(1), F.length(token) - 2), acc["paths"]))
            .when(token == ">", same(F.slice(acc["open"], F.lit(1), F.size(acc["open"]) - 1), F.lit(""), acc["paths"]))
            .when(token.endswith("<"), same(F.array_append(acc["open"], inner), F.lit(""), seen))
            .otherwise(same(acc["open"], F.lit(""), seen))
        )

    return F.array_sort(F.array_remove(F.array_distinct(F.aggregate(tokens, start, step, lambda acc: acc["paths"])), ""))


def record_fingerprint(paths: Column) -> Column:
    """Hash of all field paths of a record."""
    return F.sha2(F.array_join(paths, "\n").cast("binary"), 256)


def known_paths(layouts: Sequence[Layout]) -> list[str]:
    """All paths that speak in some layout: a record of another layout that has one of them would lose something."""
    out: set[str] = set()
    for part in (p for x in layouts for p in x.parts):
        names = [n for alts in part.fields for n in alts]
        if part.kind == "text":
            out.update(names)
        else:
            out.update({part.path, f"{part.path}[]", f"{part.path}[][]"}, (f"{part.path}[].{n}" for n in (*names, *(part.roles if part.kind == "list" else ()))))
    return sorted(out)


def resolved(paths: Column, layouts: Sequence[Layout]) -> Column:
    """Struct of layout, parts (of each slot the names that a record of these paths has) and reason."""
    known = F.array(*[F.lit(p) for p in known_paths(layouts)])
    listed = [{"name": x.name, "parts": [asdict(p) for p in x.parts]} for x in layouts]
    # one literal, whatever the number of layouts
    every = F.from_json(F.lit(json.dumps(listed)), f"array<struct<name:string,parts:array<{PART}>>>")
    has = lambda path: F.array_contains(paths, path)
    # a list is a text only if its elements are content parts, an object never is
    plain = lambda path: has(path) & (~has(F.concat(path, F.lit("[]"))) | has(F.concat(path, F.lit("[].text")))) & ~F.exists(paths, lambda p: p.startswith(F.concat(path, F.lit("."))))

    def fitted(p: Column) -> Column:
        inside = lambda n: F.concat(p["path"], F.lit("[]."), n)
        is_text, is_list = p["kind"] == "text", p["kind"] == "list"
        first = F.transform(p["fields"], lambda alts: F.slice(F.filter(alts, plain), 1, 1))
        there = F.transform(p["fields"], lambda alts: F.filter(alts, lambda n: has(inside(n))))
        fields = F.when(is_text, first).otherwise(there)
        roles = F.when(is_list, F.filter(p["roles"], lambda n: has(inside(n)))).otherwise(p["roles"])
        some = lambda alts: F.size(alts) > 0
        fits = (
            F.when(is_text, some(F.get(fields, 0)))
            .when(is_list & p["exact"], has(inside(F.get(p["roles"], 0))) & has(inside(F.get(F.get(p["fields"], 0), 0))))
            .when(is_list, some(roles) & some(F.get(fields, 0)))
            .when(p["kind"] == "pairs", F.forall(fields, some))
            .otherwise(has(F.concat(p["path"], F.lit("[][]"))) | (has(F.concat(p["path"], F.lit("[]"))) & ~F.exists(paths, lambda x: x.startswith(F.concat(p["path"], F.lit("[]."))))))
        )
        named = F.flatten(fields)
        top = F.array(p["path"], F.concat(p["path"], F.lit("[]")))
        inner = F.concat(F.transform(named, inside), F.when(is_list, F.transform(roles, inside)).otherwise(F.array().cast("array<string>")))
        more = F.when(p["kind"] == "tuples", F.array(F.concat(p["path"], F.lit("[][]")))).otherwise(F.array().cast("array<string>"))
        of_texts = F.flatten(F.transform(named, lambda n: F.array(n, F.concat(n, F.lit("[]")))))
        used = F.when(is_text, of_texts).when(fits, F.concat(top, inner, more)).otherwise(F.array().cast("array<string>"))
        part = F.struct(p["kind"].alias("kind"), p["path"].alias("path"), roles.alias("roles"), fields.alias("fields"), p["needed"].alias("needed"), p["beside"].alias("beside"), p["aside"].alias("aside"), p["exact"].alias("exact"))
        return F.struct(part.alias("part"), fits.alias("fits"), used.alias("used"))

    tried = F.transform(every, lambda x: F.struct(x["name"].alias("name"), F.transform(x["parts"], fitted).alias("parts")))
    fitting = F.filter(tried, lambda x: F.forall(x["parts"], lambda p: p["fits"] | ~p["part"]["needed"]))
    left = F.transform(
        fitting,
        lambda x: F.struct(
            x["name"].alias("name"),
            F.transform(F.filter(x["parts"], lambda p: p["fits"]), lambda p: p["part"]).alias("parts"),
            F.array_sort(F.array_except(F.array_intersect(paths, known), F.flatten(F.transform(x["parts"], lambda p: p["used"])))).alias("out"),
        ),
    )
    whole = F.get(F.filter(left, lambda x: F.size(x["out"]) == 0), 0)
    reason = F.when(whole.isNotNull(), F.lit(None)).when(F.size(left) > 0, F.concat(F.lit("leaves out "), F.array_join(F.get(left, 0)["out"], ", "))).otherwise(F.lit("no layout"))
    return F.struct(whole["name"].alias("layout"), whole["parts"].alias("parts"), reason.alias("reason"))


class VariantRecord:
    """Reads fields of parsed records."""

    def __init__(self, parsed: Column):
        self.parsed = parsed

    def text(self, value: Column | None, field: Column) -> Column:
        """A field's text, of the record or of a list's element; a list of parts is its parts' texts by line."""
        value, path = self.parsed if value is None else value, F.concat(F.lit("$."), field)
        part = lambda p: F.coalesce(F.try_variant_get(p, "$.text", "string"), F.try_variant_get(p, "$", "string"))
        return F.coalesce(F.array_join(F.transform(F.try_variant_get(value, path, "array<variant>"), part), "\n"), F.try_variant_get(value, path, "string"))

    def elements(self, path: Column) -> Column:
        return F.try_variant_get(self.parsed, F.concat(F.lit("$."), path), "array<variant>")

    def texts(self, element: Column) -> Column:
        """The texts of an element that is a list; null for another."""
        return F.try_variant_get(element, "$", "array<string>")

    def plain(self, element: Column) -> Column:
        return F.try_variant_get(element, "$", "string")


class JsonRecord:
    """Reads the known fields of records that are no variant: beyond its size limits, or with repeated names (the last counts)."""

    def __init__(self, record: Column):
        self.row = self.fields(record)

    @staticmethod
    def fields(text: Column) -> Column:
        return F.map_entries(F.from_json(text, "map<string,string>", ANY_LENGTH))

    @staticmethod
    def of(entries: Column, name: Column) -> Column:
        found = F.filter(entries, lambda e: e["key"] == name)
        return F.get(found, F.size(found) - 1)["value"]

    def paths(self, layouts: Sequence[Layout]) -> Column:
        known = known_paths(layouts)
        lists = F.array(*[F.lit(x) for x in sorted({p.removesuffix("[]") for p in known if p.endswith("[]") and not p.endswith("[][]")})])
        names = F.array_distinct(F.transform(self.row, lambda e: e["key"]))

        def inside(name: Column) -> Column:
            text = self.of(self.row, name)
            keys = F.flatten(F.transform(F.from_json(text, "array<map<string,string>>", ANY_LENGTH), lambda m: F.map_keys(m)))
            nested = F.from_json(text, "array<array<string>>", ANY_LENGTH)
            return F.concat(
                F.when(F.from_json(text, "array<string>", ANY_LENGTH).isNotNull(), F.array(F.concat(name, F.lit("[]")))).otherwise(F.array().cast("array<string>")),
                F.coalesce(F.transform(keys, lambda k: F.concat(name, F.lit("[]."), k)), F.array().cast("array<string>")),
                F.when(F.exists(nested, lambda x: x.isNotNull()), F.array(F.concat(name, F.lit("[][]")))).otherwise(F.array().cast("array<string>")),
            )

        found = F.concat(names, F.flatten(F.transform(F.array_intersect(names, lists), inside)))
        return F.array_sort(F.array_intersect(F.array(*[F.lit(p) for p in known]), found))

    def text(self, value: Column | None, field: Column) -> Column:
        return self.of(self.row, field) if value is None else self.of(self.fields(value), field)

    def elements(self, path: Column) -> Column:
        return F.from_json(self.of(self.row, path), "array<string>", ANY_LENGTH)

    def texts(self, element: Column) -> Column:
        return F.from_json(element, "array<string>", ANY_LENGTH)

    def plain(self, element: Column) -> Column:
        return element


def _turn(role: Column, text: Column) -> Column:
    return F.struct(F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text")).cast(TURN)


def _said(record: VariantRecord | JsonRecord, parts: Column) -> Column:
    """The turns of each part of a resolved mapping."""
    renames = F.create_map(*[F.lit(x) for pair in ROLE_NAMES.items() for x in pair])
    first = lambda values: F.get(F.filter(values, lambda v: v.isNotNull()), 0)
    none = F.array().cast(TURNS)

    def turns(p: Column) -> Column:
        texts = F.transform(F.flatten(p["fields"]), lambda n: record.text(None, n))
        told = F.array_join(F.filter(texts, lambda t, i: t.isNotNull() & ((i == 0) | (t != ""))), "\n\n")
        one = F.when(p["needed"] | F.get(texts, 0).isNotNull(), F.array(_turn(F.get(p["roles"], 0), told))).otherwise(none)

        def message(e: Column) -> Column:
            role = first(F.transform(p["roles"], lambda f: F.when(f == "role", record.text(e, f)).otherwise(F.coalesce(renames[record.text(e, f)], record.text(e, f)))))
            return _turn(role, first(F.transform(F.get(p["fields"], 0), lambda f: record.text(e, f))))

        def pair(e: Column) -> Column:
            slots = F.transform(p["fields"], lambda alts, i: F.struct(F.get(p["roles"], i).alias("role"), first(F.transform(alts, lambda f: record.text(e, f))).alias("text")).cast(TURN))
            return F.filter(slots, lambda t: t["text"].isNotNull())

        def spoken(e: Column, i: Column) -> Column:
            role = lambda n: F.get(p["roles"], (n % F.size(p["roles"])).cast("int"))
            return F.coalesce(F.transform(record.texts(e), lambda t, n: _turn(role(n), t)), F.when(record.plain(e).isNotNull(), F.array(_turn(role(i), record.plain(e)))), none)

        elements = record.elements(p["path"])
        return (
            F.when(p["kind"] == "text", one)
            .when(p["kind"] == "list", F.transform(elements, message))
            .when(p["kind"] == "pairs", F.flatten(F.transform(elements, pair)))
            .otherwise(F.flatten(F.transform(elements, spoken)))
        )

    return F.transform(parts, lambda p: F.struct(p["beside"].alias("beside"), p["aside"].alias("aside"), (p["kind"] != "text").alias("listed"), F.coalesce(turns(p), none).alias("turns")).cast(SAID))


def printed_records(df: DataFrame, record: str, layouts: Sequence[Layout] = LAYOUTS) -> tuple[DataFrame, dict[str, str]]:
    """The records parsed, with paths and fingerprint, other columns by their places; and those columns' names."""
    names = {c: f"c{i}" for i, c in enumerate(df.columns)}
    rows = df.select(*[F.col(c).alias(h) for c, h in names.items()], F.col(record).alias("record"), F.try_parse_json(F.col(record)).alias("parsed"))
    paths = F.when(F.col("parsed").isNotNull(), field_paths(F.col("parsed"))).otherwise(JsonRecord(F.col("record")).paths(layouts))
    rows = rows.withColumn("paths", paths)
    return rows.withColumn("fingerprint", F.when(F.size("paths") > 0, record_fingerprint(F.col("paths")))), names


def layout_registry(df: DataFrame, record: str = "record", layouts: Sequence[Layout] = LAYOUTS) -> DataFrame:
    """(fingerprint, layout, parts, reason): each distinct fingerprint of the records, resolved once, as a stored table."""
    rows, _ = printed_records(df, record, layouts)
    each = rows.where(F.col("fingerprint").isNotNull()).groupBy("fingerprint").agg(F.first("paths").alias("paths"))
    return table(each.select("fingerprint", resolved(F.col("paths"), layouts).alias("r")).select("fingerprint", "r.*"), "layouts")


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL_FIRST + r"(\\*)" + CONTROL_REST, r"$1$2\\$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL_FIRST + r"\\(\\*)" + CONTROL_REST, "$1$2$3")


def escape_role(role: Column) -> Column:
    """Also keeps line ends out of a role: they end it in the template."""
    return escape(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def format_chats(df: DataFrame, record: str = "record", learn: str = "assistant", *, layouts: Sequence[Layout] = LAYOUTS, registry: DataFrame | None = None, details: bool = False) -> DataFrame:
    """Adds fingerprint, layout, formatted and loss_spans (array of start and length in code points, one for each ``learn`` turn); with details, reason and aside.

    ``layouts``: the mappings, in order of priority; ``registry``: their table by fingerprint, made from the records if not
    given. A null or malformed record and one of no known layout have layout, aside, formatted and loss_spans null, and a
    reason: ``no record``, ``no layout``, or ``leaves out`` with the paths that the first fitting layout would lose; paths
    that are in no layout are taken for facts about the record and do no harm. aside: turns of the parts that are none,
    the rejected answer say. A message without role or text has it empty, an empty list of messages is no layout.

    A record that the variant parser refuses (over 134,217,728 bytes as a variant, a string of over 20,000,000 characters, or
    a field name twice in one object: there the last counts) is read by its known fields instead: its fingerprint is of
    these, a list of content parts stays JSON, and lists within an object (``data.messages``) are not seen. Texts of any
    length, repeated rows and ties are formatted one by one; an empty table has an empty result. Other columns stay, whatever
    their names; those named like the results are replaced.
    """
    results = ("fingerprint", "layout", *(("reason", "aside") if details else ()), "formatted", "loss_spans")
    registry = layout_registry(df, record, layouts) if registry is None else registry
    rows, names = printed_records(df, record, layouts)
    found = registry.select(F.col("fingerprint").alias("of"), "layout", "parts", "reason")
    # the table's size is known: the optimiser broadcasts it if it is small, and splits a hot fingerprint if it is not
    rows = rows.join(found, F.col("fingerprint") == F.col("of"), "left")
    said = F.when(F.col("parsed").isNotNull(), _said(VariantRecord(F.col("parsed")), F.col("parts"))).otherwise(_said(JsonRecord(F.col("record")), F.col("parts")))
    rows = rows.withColumn("said", F.when(F.col("layout").isNotNull(), said))
    some = lambda keep: F.flatten(F.transform(F.filter("said", keep), lambda s: s["turns"]))
    rows = rows.withColumn("listed", some(lambda s: s["listed"] & ~s["aside"]))
    told = F.transform(F.filter("said", lambda s: ~s["aside"]), lambda s: F.filter(s["turns"], lambda t: ~s["beside"] | ~F.array_contains(F.col("listed"), t)))
    rows = rows.withColumns({"turns": F.flatten(told), "aside": some(lambda s: s["aside"]), "reason": F.coalesce("reason", F.when(F.col("layout").isNull(), F.lit("no record")))})
    kept = [c for c in df.columns if c not in results]
    out = _formatted(rows, "turns", [*[names[c] for c in kept], "fingerprint", "layout", "reason", "aside"], learn)
    return out.select(*[F.col(names[c]).alias(c) for c in kept], *results)


def format_turns(df: DataFrame, turns: str = "turns", learn: str = "assistant") -> DataFrame:
    """Adds formatted and loss_spans, as format_chats, for turns that are an array of structs of role and text.

    Nothing is written as JSON or parsed. Null turns have both null, no turns an empty text and no spans.
    """
    names = {c: f"c{i}" for i, c in enumerate(df.columns)}
    empty = lambda t: F.struct(F.coalesce(t["role"], F.lit("")).alias("role"), F.coalesce(t["text"], F.lit("")).alias("text"))
    rows = df.select(*[F.col(c).alias(h) for c, h in names.items()], F.transform(turns, empty).alias("turns"))
    kept = {c: h for c, h in names.items() if c not in ("formatted", "loss_spans")}
    out = _formatted(rows, "turns", list(kept.values()), learn)
    return out.select(*[F.col(h).alias(c) for c, h in kept.items()], "formatted", "loss_spans")


def _formatted(rows: DataFrame, turns: str, kept: list[str], learn: str) -> DataFrame:
    """The kept columns, formatted and loss_spans; no column may be called pieces."""
    rows = rows.withColumn(
        "pieces",
        F.transform(
            turns,
            lambda t: F.struct(
                F.concat(F.lit(START), escape_role(t["role"]), F.lit("\n")).alias("head"), escape(t["text"]).alias("body"), (t["role"] == learn).alias("learn")
            ),
        ),
    )
    formatted = F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"], F.lit(END))), "")
    span = "struct<start:long,length:long>"
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(f"array<{span}>").alias("spans"))

    def add(acc: Column, p: Column) -> Column:
        begin = acc["at"] + F.length(p["head"])
        here = F.array(F.struct(begin.alias("start"), F.length(p["body"]).cast("long").alias("length")).cast(span))
        return F.struct(
            (begin + F.length(p["body"]) + F.lit(len(END))).cast("long").alias("at"),
            F.when(p["learn"], F.concat(acc["spans"], here)).otherwise(acc["spans"]).alias("spans"),
        )

    spans = F.aggregate("pieces", start, add, lambda acc: acc["spans"])
    return rows.select(*kept, formatted.alias("formatted"), spans.alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """The turns back from formatted text: the inverse of the template."""
    pieces = F.filter(F.split(formatted, r"<\|im_end\|>\n", -1), lambda p: p != "")
    role = lambda p: F.substring_index(p, "\n", 1)
    return F.transform(
        pieces,
        lambda p: F.struct(
            unescape_role(F.substr(role(p), F.lit(len(START) + 1))).alias("role"),
            unescape(F.substr(p, F.length(role(p)) + F.lit(2))).alias("text"),
        ),
    )


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")


def _ordered(turn: str, role: str, text: str, name: str) -> Column:
    """A group's turns in order, their text under a name."""
    message = F.struct(F.col(turn), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("content"))
    return F.transform(F.sort_array(F.collect_list(message)), lambda m: F.struct(m["role"].alias("role"), m["content"].alias(name)))


def conversation_turns(rows: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turns): role and text of each conversation's turns, in the order of conversation_records."""
    return rows.groupBy(F.col(conv_id).alias("conv_id")).agg(_ordered(turn, role, text, "text").alias("turns"))


def conversation_records(rows: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, record): one JSON record in the ``messages`` layout of each conversation, turns in order.

    Equal turn numbers are ordered by role and text, null turns come first, null texts and roles are empty, and
    rows of a null id form one conversation. Repeated rows are repeated turns.
    """
    turns = _ordered(turn, role, text, "content")
    return rows.groupBy(F.col(conv_id).alias("conv_id")).agg(F.to_json(F.struct(turns.alias("messages"))).alias("record"))


def heterogeneous_records(chats: DataFrame, *, key: str = "conv_id", turns: str = "turns", more: bool = False) -> DataFrame:
    """(key, record): turns as JSON records of nine layouts in turn by the key, with ``more`` of one of each family; format_chats gives the same turns back.

    A conversation whose turns a layout cannot hold is written as messages: single turns hold one user and one assistant
    turn, with a system turn or without; lists with other names for roles hold the three known roles only; pairs hold a user and
    an assistant turn by turns. An empty table has an empty result.
    """
    said = F.col(turns)
    role = lambda i: said[i]["role"]
    has_system = (F.size(said) == 3) & (role(0) == "system")
    at = F.when(has_system, 1).otherwise(0)
    single = (F.size(said) == at + 2) & (said[at]["role"] == "user") & (said[at + 1]["role"] == "assistant")
    known = F.forall(said, lambda t: t["role"].isin("system", "user", "assistant"))
    theirs = F.create_map(*[F.lit(x) for x in ("user", "human", "assistant", "gpt", "system", "system")])
    as_list = lambda role_field, text_field, rows, name=lambda r: r: F.transform(rows, lambda t: F.struct(name(t["role"]).alias(role_field), t["text"].alias(text_field)))
    led = (role(0) == "system") & (F.size(said) > 1) & ~F.exists(F.slice(said, F.lit(2), F.size(said)), lambda t: t["role"] == "system")
    system = F.when(has_system, said[0]["text"]).alias("system")
    pair = lambda user, assistant: F.to_json(F.struct(system, said[at]["text"].alias(user), said[at + 1]["text"].alias(assistant)))
    plain = F.to_json(F.struct(as_list("role", "content", said).alias("messages")))
    forms = [
        (F.lit(True), plain),
        (known, F.to_json(F.struct(as_list("from", "value", said, lambda r: theirs[r]).alias("conversations")))),
        (F.lit(True), F.to_json(F.struct(as_list("role", "text", said).alias("turns")))),
        (F.lit(True), F.to_json(F.struct(as_list("role", "content", said).alias("conversations")))),
        (led, F.to_json(F.struct(said[0]["text"].alias("system"), as_list("role", "content", F.slice(said, F.lit(2), F.size(said))).alias("messages")))),
        *[(single, pair(u, a)) for u, a in (("instruction", "output"), ("prompt", "response"), ("prompt", "completion"), ("question", "answer"))],
    ]
    if more:
        opened = (role(0) == "system") & (F.size(said) > 1)
        system = F.when(opened, said[0]["text"]).alias("system")
        rest = F.slice(said, F.when(opened, 2).otherwise(1), F.size(said))
        alternate = (F.size(rest) > 0) & (F.size(rest) % 2 == 0) & F.forall(F.transform(rest, lambda t, i: t["role"] == F.when(i % 2 == 0, "user").otherwise("assistant")), lambda x: x)
        halves = lambda rows, make: F.transform(F.sequence(F.lit(0), (F.size(rows) / 2 - 1).cast("int")), lambda i: make(F.get(rows, 2 * i)["text"], F.get(rows, 2 * i + 1)["text"]))
        paired = lambda rows, u, a: F.when(F.size(rows) >= 2, halves(rows, lambda x, y: F.struct(x.alias(u), y.alias(a))))
        earlier = F.slice(rest, F.lit(1), F.greatest(F.size(rest) - 2, F.lit(0)))
        ended = (F.size(said) > 1) & (F.element_at(said, -1)["role"] == "assistant")
        body = F.slice(said, F.lit(1), F.greatest(F.size(said) - 1, F.lit(0)))
        last = F.get(said, F.size(said) - 1)["text"]
        history = lambda u, a: F.to_json(F.struct(system, F.coalesce(halves(earlier, lambda x, y: F.array(x, y)), F.array().cast("array<array<string>>")).alias("history"), F.get(rest, F.size(rest) - 2)["text"].alias(u), last.alias(a)))
        forms += [
            (F.lit(True), F.to_json(F.struct(F.struct(as_list("role", "content", said).alias("messages")).alias("data")))),
            (known, F.to_json(F.struct(as_list("speaker", "text", said, lambda r: theirs[r]).alias("dialogue")))),
            (F.lit(True), F.to_json(F.struct(F.transform(said, lambda t: F.struct(t["role"].alias("role"), F.array(F.struct(t["text"].alias("text"))).alias("parts"))).alias("messages")))),
            (alternate, F.to_json(F.struct(system, paired(rest, "human", "assistant").alias("conversation")))),
            (alternate & (F.size(rest) > 2), history("instruction", "output")),
            (ended, F.to_json(F.struct(as_list("role", "content", body).alias("messages"), last.alias("output")))),
            (ended, F.to_json(F.struct(as_list("role", "content", body).alias("prompt"), as_list("role", "content", F.slice(said, F.size(said), F.lit(1))).alias("completion")))),
            (ended, F.to_json(F.struct(as_list("role", "content", said).alias("chosen"), as_list("role", "content", body).alias("rejected")))),
            *[(single, pair(u, a)) for u, a in (("input", "output"), ("query", "response"), ("human", "assistant"), ("prompt", "chosen"))],
        ]
    turn = F.pmod(F.xxhash64(F.col(key)), F.lit(len(forms)))
    picked = F.coalesce(*[F.when((turn == i) & fits, form) for i, (fits, form) in enumerate(forms)], plain)
    return chats.select(key, picked.alias("record"))
