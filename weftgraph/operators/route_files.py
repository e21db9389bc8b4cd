"""Routes that route files define: verbs and resources, inside groups that add prefixes and middleware.

Files are cut into statements, each up to its `;`, `{` or `}`; strings and comments are taken whole, so that brackets in either count for
nothing. A group is a statement that opens a block. Only statements that open or close something become rows of windows: the depth of blocks is a running
sum over them, and a block ends at the next brace of its level. What they give is one row for each file, which meets the file's text again. Then each file is read
in one pass in a task: a statement takes the prefixes and middleware of every group whose block it stands in, and its call is read where it stands: routes are never sorted or dealt out.

A route without a controller class (closures, views) is none, nor is one without a path or in a comment. Blocks without an end give no
group. Null texts and empty tables give no routes; repeated rows of a file count once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.functions.text import normalize_route_path
from weftgraph.model import CodeGraph
from weftgraph.operators.links import RESOURCE_ROUTES

_QUOTED = r"'(?:[^'\\]++|\\[\s\S])*+(?:'|\z)|\"(?:[^\"\\]++|\\[\s\S])*+(?:\"|\z)"
_COMMENT = r"/\*[\s\S]*?(?:\*/|\z)|(?://|#)[^\n]*+"
#: A statement with the bracket or semicolon that ends it.
STATEMENT = rf"(?:{_COMMENT}|{_QUOTED}|[^'\"/#;{{}}]++|/)*+(?:[;{{}}]|\z)"
#: What parentheses hold, with up to three more levels of them inside, and a statement that closes all it opens; what is deeper is counted.
_CLOSED = rf"\((?:{_QUOTED}|[^'\"()]++)*+\)"
for _ in range(3):
    _CLOSED = rf"\((?:{_QUOTED}|[^'\"()]++|{_CLOSED})*+\)"
_PLAIN = rf"^(?:{_QUOTED}|[^'\"(){{}};]++|{_CLOSED})*+;?$"
# Calls that define routes, from their name to the end of the statement.
ROUTE_CALL = r"(?i:Route)::(?=((?i:get|post|put|patch|delete|resource|apiResource)\([\s\S]*+))"
_STRING, _CLASS = r"'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\"", r"[A-Za-z_\\][A-Za-z0-9_\\]*(?=::class)"
#: What stands in the parentheses of a call, with one more level of them inside.
_INSIDE = r"\(((?:'[^']*'|\"[^\"]*\"|[^()'\"]|\([^()]*\))*)\)"


def _unquoted(c: Column) -> Column:
    return F.substr(c, F.lit(2), F.length(c) - 2)


def _strings(text: Column) -> Column:
    """The string literals of a text, in order."""
    return F.transform(F.regexp_extract_all(text, F.lit(_STRING), F.lit(0)), _unquoted)


def _class(raw: Column, uses: Column) -> Column:
    """A class by its full name: as it stands if that has a namespace, else as it was imported; of two imports the later counts."""
    bare = F.regexp_replace(raw, r"^\\", "")
    return F.when(F.contains(bare, F.lit("\\")), bare).otherwise(F.coalesce(F.try_element_at(F.filter(uses, lambda u: u["alias"] == bare), F.lit(-1))["class"], bare))


def _named(text: Column, uses: Column) -> Column:
    """Strings and then classes that a text names."""
    return F.concat(_strings(text), F.transform(F.regexp_extract_all(text, F.lit(_CLASS), F.lit(0)), lambda c: _class(c, uses)))


def _middleware(text: Column, uses: Column) -> Column:
    """What the calls of `middleware` in a text name."""
    calls = F.regexp_extract_all(text, F.lit(r"(?i)(?:Route::|->)middleware" + _INSIDE), F.lit(1))
    return F.flatten(F.transform(calls, lambda c: _named(c, uses)))


def _some(values: Column) -> Column:
    return F.array_distinct(F.filter(values, lambda v: v != ""))


def imports(text: Column) -> Column:
    """What a file imports: (alias, class) in order, by the name in use."""

    def one(use: Column) -> Column:
        parts = F.split(F.trim(use), r"(?i)\s+as\s+")
        full = F.regexp_replace(F.trim(parts[0]), r"^\\", "")
        return F.struct(F.coalesce(F.nullif(F.trim(F.get(parts, F.lit(1))), F.lit("")), F.substring_index(full, "\\", -1)).alias("alias"), full.alias("class"))

    found = F.filter(F.regexp_extract_all(text, F.lit(r"(?m)^\s*use\s+([^;]+);"), F.lit(1)), lambda u: ~F.startswith(F.trim(u), F.lit("function ")))
    return F.filter(F.transform(found, one), lambda u: (u["class"] != "") & (u["alias"] != ""))


def statements(files: DataFrame) -> DataFrame:
    """`files` (file, text and more) with a row for each statement: its number `at` and `said`, what it says without comments, and white space outside strings."""
    kept = [c for c in files.columns if c != "text"]
    said = F.transform(F.regexp_extract_all("text", F.lit(STATEMENT), F.lit(0)), lambda raw: F.regexp_replace(raw, rf"((?:{_QUOTED}|[^'\"/#\s]++|/(?![/*]))++)|{_COMMENT}|\s++", "$1"))
    return files.select(*kept, F.posexplode_outer(said).alias("at", "said")).where("said <> ''")


def _depths(said: Column) -> Column:
    """(depth, least): parentheses open after a text, and the fewest on the way."""
    zero = F.struct(*[F.lit(0).alias(n) for n in ("depth", "least")])

    def step(s: Column, token: Column) -> Column:
        depth = s["depth"] + F.when(token == "(", 1).when(token == ")", -1).otherwise(0)
        return F.struct(depth.alias("depth"), F.least(s["least"], depth).alias("least"))

    return F.aggregate(F.regexp_extract_all(said, F.lit(rf"{_QUOTED}|[()]"), F.lit(0)), zero, step)


def _once(value: Column) -> Column:
    """A value that filters and later columns read without making it again: they do not pass through an explosion (an inner one is made twice itself)."""
    return F.explode_outer(F.array(value))


def brackets(files: DataFrame) -> DataFrame:
    """(file, groups, later) of files (file, text, uses): the groups' blocks (start, end, prefix, middleware) by statements, and for statements that leave
    parentheses open or close others' the fewest that stay open after them (at, least), counted from their beginning."""
    brace = F.right("said", F.lit(1)).isin("{", "}")
    d = statements(files).where(~F.col("said").rlike(_PLAIN)).select("*", _once(_depths(F.col("said"))).alias("d")).where(brace | (F.col("d.depth") != 0) | (F.col("d.least") < 0))
    order = Window.partitionBy("file").orderBy("at")
    opens, ends = F.endswith("said", F.lit("{")), F.endswith("said", F.lit("}"))
    d = d.withColumns({"before": F.sum("d.depth").over(order) - F.col("d.depth"), "level": F.sum(F.when(opens, 1).when(ends, -1).otherwise(0)).over(order) + F.when(ends, 1).otherwise(0)})
    after = Window.partitionBy("file").orderBy(F.desc("at")).rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("least", F.min(F.col("before") + F.col("d.least")).over(after) - F.col("before"))
    partner = Window.partitionBy("file", "brace", "level").orderBy("at")
    d = d.withColumn("brace", opens | ends).withColumn("end", F.when(opens & F.endswith(F.lead("said").over(partner), F.lit("}")), F.lead("at").over(partner)))
    said, by = F.regexp_extract("said", rf"^(?:{_QUOTED}|(?!(?i:Route)::\w)[^'\"])*+((?i:Route)::[\s\S]*+)$", 1), F.col("uses")
    d = d.withColumn("head", F.when(F.col("end").isNotNull(), said))
    prefixes = F.regexp_extract_all("head", F.lit(r"(?i)(?:Route::|->)prefix\((['\"])([^'\"]+)\1\)"), F.lit(2))
    listed = F.regexp_extract("head", r"(?i)['\"]prefix['\"]=>['\"]([^'\"]+)['\"]", 1)
    in_list = F.regexp_extract("head", r"(?i)['\"]middleware['\"]=>(\[[^\]]*\]|'[^']+'|\"[^\"]+\"|[A-Za-z_\\][A-Za-z0-9_\\]*::class)", 1)
    group = F.struct(
        F.col("at").alias("start"), "end",
        F.array_join(_some(F.concat(prefixes, F.array(listed))), "/").alias("prefix"),
        _some(F.concat(_middleware(F.col("head"), by), _named(in_list, by))).alias("middleware"),
    )
    is_group = F.col("head").rlike(r"(?is)(?:Route::|->)group\(.*function")
    unclosed = (F.col("d.depth") > 0) | (F.col("d.least") < 0)
    return d.groupBy("file").agg(F.array_sort(F.collect_list(F.when(is_group, group))).alias("groups"), F.collect_list(F.when(unclosed & F.col("least").isNotNull(), F.struct("at", "least"))).alias("later"))


#: The patterns by which statements and calls are read in tasks. Classes and cases are those of ASCII, and ends of lines those that Java's patterns know, as in the columns above.
_read = lambda pattern: re.compile(pattern.replace(r"\z", r"\Z"), re.ASCII)
_STATEMENTS, _SAID = _read(STATEMENT), _read(rf"((?:{_QUOTED}|[^'\"/#\s]++|/(?![/*]))++)|{_COMMENT}|\s++")
_ROUTES, _ENDS, _TOKENS = _read(rf"{_QUOTED}|{ROUTE_CALL}"), _read(_CLOSED), _read(rf"{_QUOTED}|[()]|[^'\"()]++")
_ANY_ROUTE = _read(ROUTE_CALL)
_STRINGS, _CLASSES = _read(_STRING.replace(r"\\.", r"\\[^\n\r\u0085\u2028\u2029]")), _read(_CLASS)
_PAIR = _read(r"\[([A-Za-z0-9_\\]+)::class,['\"]([^'\"]+)['\"]\]")
_NAME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_\\")
_GUARDS, _LISTED = _read(r"(?i)(?:Route::|->)middleware" + _INSIDE), _read(r"['\"]([^'\"]+)['\"]")
_CHOSEN = {name: _read(rf"->{name}\(([^)]*)\)") for name in ("only", "except")}
_SLASHES, _LAST_SLASHES = re.compile("/+"), re.compile(r"/+(?=(?:\r\n|[\n\r\u0085\u2028\u2029])?\Z)")

ROUTES = "file string, at bigint, verb string, path string, controller string, action string, middleware array<string>, mount string"


def _token_depths(text: str) -> tuple[int, int]:
    """(depth, end): parentheses open after a text, and the place after the one that closes what it begins with (0: nothing does)."""
    depth = place = end = 0
    for token in _TOKENS.findall(text):
        place += len(token)
        depth += (token == "(") - (token == ")")
        if token == ")" and depth == 0 and end == 0:
            end = place
    return depth, end


def _calls_of(text: str) -> Iterator[tuple[int, int, str, str]]:
    """(spot, nth, said, call) of the calls in a file that may define routes: `call` goes from its name to the end of its statement."""
    for spot, m in enumerate(_STATEMENTS.finditer(text)):
        said = "".join(_SAID.findall(m.group()))
        lower = said.lower()
        at = lower.find("route::")
        if at < 0:
            continue
        if len(lower) == len(said) and lower.find("route::", at + 1) < 0 and "'" not in said[:at] and '"' not in said[:at]:
            # one name, and no string before it
            if (found := _ANY_ROUTE.search(said, at)) is not None:
                yield spot, 0, said, found.group(1)
            continue
        for nth, found in enumerate(_ROUTES.finditer(said)):
            if found.group(1):
                yield spot, nth, said, found.group(1)


def _first_class(args: str) -> str:
    """The first name before `::class`; empty without one."""
    end = args.find("::class")
    while end >= 0:
        start = end
        while start and args[start - 1] in _NAME:
            start -= 1
        if start < end:
            return args[start:end]
        end = args.find("::class", end + 1)
    return ""


def _file_routes(file: str, text: str, mount: str | None, uses: list[dict], groups: list[dict] | None, later: list[dict] | None) -> Iterator[tuple]:
    """The rows of `routes` for one file."""
    imported = {u["alias"]: u["class"] for u in uses}
    open_after = {x["at"]: x["least"] for x in reversed(later or [])}
    around, prefix, above = None, "", []

    def full(raw: str) -> str:
        bare = raw.removeprefix("\\")
        return bare if "\\" in bare else imported.get(bare, bare)

    def guards(text: str) -> list[str]:
        return [x for inner in _GUARDS.findall(text) for x in (*(s[1:-1] for s in _STRINGS.findall(inner)), *(map(full, _CLASSES.findall(inner)) if "::class" in inner else ()))]

    for spot, nth, said, c in _calls_of(text):
        at = c.index("(")
        kind, call = c[:at].lower(), c[at:]
        near = _ENDS.match(call)
        closed = near.end() if near else _token_depths(call)[1]
        # one that its statement leaves open counts if a later statement closes it
        if not closed and not (spot in open_after and open_after[spot] <= _token_depths(said[: len(said) - len(c)])[0]):
            continue
        args, tail = (call[1 : closed - 1], call[closed:]) if closed else (call[1:], "")
        pair, literal = _PAIR.search(args), _STRINGS.search(args)
        raw = pair.group(1) if pair else _first_class(args)
        if not raw or not literal or len(literal.group()) == 2:
            continue
        path = literal.group()[1:-1]
        now = [n for n, g in enumerate(groups or ()) if g["start"] < spot <= g["end"]]
        if now != around:
            around, inside = now, [groups[n] for n in now]
            prefix = _LAST_SLASHES.sub("", "/".join(p for p in (mount or "", *(g["prefix"] for g in inside)) if p))
            above = list(dict.fromkeys(m for g in inside for m in g["middleware"] if m))
        middleware = list(dict.fromkeys((*above, *(m for m in guards(tail) if m)))) if "middleware" in tail.lower() else above
        rows = ((kind.upper(), "", pair.group(2) if pair else "__invoke"),)
        if kind in ("resource", "apiresource"):
            chosen = {name: _LISTED.findall(m.group(1)) if (m := pattern.search(tail)) else [] for name, pattern in _CHOSEN.items()}
            rows = [r for r in RESOURCE_ROUTES if (kind == "resource" or r[2] not in ("create", "edit")) and (not chosen["only"] or r[2] in chosen["only"]) and r[2] not in chosen["except"]]
            path = "/{param}/".join(x for x in path.split(".") if x)
        base, controller = f"{prefix}/{path}", full(raw)
        for verb, suffix, does in rows:
            whole = base + suffix
            yield file, (spot << 32) + nth, verb, _SLASHES.sub("/", whole) if "//" in whole else whole, controller, does, middleware, mount


def routes(files: DataFrame) -> DataFrame:
    """(file, at, verb, path, controller, action, middleware, mount) of files (file, text, and mount: a path before all routes of the file).

    Resources give their REST rows, less what `only` and `except` leave out. Middleware is in order: outer groups, inner groups, the route's own.
    """
    mount = F.col("mount").cast("string") if "mount" in files.columns else F.lit(None).cast("string")
    # dealt out by file once; the text is that of the file's greatest row
    one = files.where("file IS NOT NULL AND text IS NOT NULL").select("file", "text", mount.alias("mount")).repartition("file").groupBy("file").agg(F.max(F.struct("text", "mount")).alias("f"))
    one = one.select("file", "f.text", "f.mount").withColumn("uses", imports(F.col("text")))
    names = [c.split()[0] for c in ROUTES.split(", ")]

    def read(table):  # noqa: ANN001, ANN202
        """The routes of a group of one file: no more than that file is held at once."""
        import pyarrow as pa

        kinds = pa.schema([(n, pa.int64() if n == "at" else pa.list_(pa.string()) if n == "middleware" else pa.string()) for n in names])
        rows = [r for f in table.to_pylist() for r in _file_routes(**f)]
        return pa.Table.from_arrays([pa.array(c, kinds.field(i).type) for i, c in enumerate(zip(*rows, strict=True))], schema=kinds) if rows else kinds.empty_table()

    # an expression for each of their parts costs several times the processor time of one pass over the text
    whole = one.join(brackets(one.select("file", "text", "uses")), "file", "left").select("file", "text", "mount", "uses", "groups", "later")
    return whole.groupBy("file").applyInArrow(read, ROUTES)


def route_graph(found: DataFrame) -> CodeGraph:
    """Endpoints, their handlers and middleware as a graph; an endpoint that several files define is that of the file which sorts first."""
    label = F.concat_ws(" ", "verb", "path")
    r = found.select("*", F.concat(F.lit("api:"), F.col("verb"), F.lit(":"), normalize_route_path(F.col("path"))).alias("id"), label.alias("label"))
    ends = r.groupBy("id").agg(F.min(F.struct("file", "at", "label")).alias("f")).select("id", F.lit("api_endpoint").alias("type"), F.col("f.label").alias("name"), F.col("f.file").alias("file"))
    through = r.select("id", "label", "file", F.explode("middleware").alias("m"))
    guards = through.groupBy("m").agg(F.min("file").alias("file")).select(F.concat(F.lit("middleware:"), F.col("m")).alias("id"), F.lit("middleware").alias("type"), F.col("m").alias("name"), "file")
    to = F.concat_ws("::", "controller", "action")
    # handlers and middleware of one route travel together, once
    ways = F.concat(
        F.array(F.struct(F.lit("ROUTES_TO").alias("type"), to.alias("to_id"), F.col("action").alias("via"))),
        F.transform("middleware", lambda m: F.struct(F.lit("USES_MIDDLEWARE").alias("type"), F.concat(F.lit("middleware:"), m).alias("to_id"), m.alias("via"))),
    )
    each = r.select("id", "label", ways.alias("ways")).repartition("id").select("id", "label", F.explode_outer("ways").alias("w")).select("id", "label", "w.*")
    joined = each.groupBy("id", "to_id", "type").agg(F.min("via").alias("via"), F.min("label").alias("reason"))
    edges = joined.select(F.concat_ws("->", "id", F.concat_ws(":", "to_id", "type")).alias("id"), F.col("id").alias("from_id"), "to_id", "type", "via", "reason")
    return CodeGraph.of(ends.unionByName(guards), edges)
