"""Predicates and classifications of nodes, edges and files as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RESOLVED = ("INTERFACE_RESOLVED", "EXTENDS_RESOLVED", "OVERRIDE_RESOLVED")
ENTRY_TYPES = ("ROUTES_TO", "BLADE_USES_ACTION")


def visible_call(include_resolved: bool = False) -> Column:
    """A call; resolved ones only if asked for."""
    call = F.col("type") == "CALLS"
    return call if include_resolved else call & (F.col("call_type").isNull() | ~F.col("call_type").isin(*RESOLVED))


def usage_edge(include_resolved: bool = False, include_depends_on: bool = False) -> Column:
    """An edge that uses its target: a visible call or an entry point; dependencies if asked for."""
    use = visible_call(include_resolved) | F.col("type").isin(*ENTRY_TYPES)
    return use | (F.col("type") == "DEPENDS_ON") if include_depends_on else use


def framework_noise(id: Column) -> Column:
    """Classes of the framework itself, and request accessors."""
    return id.rlike(r"^Illuminate\\|^Symfony\\|^Psr\\|\\Request::(all|input|get|has|filled|validate|only|except|merge)\b")


def class_of(id: Column) -> Column:
    """The part before the first `::`."""
    return F.substring_index(id, "::", 1)


# Words that mark the layers of a code base, in the order in which they are tried, with their weights.
LAYER_WEIGHTS = (
    ("(?i)Quer(y|ies)|Repositor(y|ies)|Finder|Dao|Builder|Persist", 100),
    ("(?i)Service|UseCase|Action|Handler|Interactor|Manager", 80),
    ("(?i)Factory|Provider|Resolver", 70),
    ("(?i)Generator|Transformer|Resource|Serializer|Presenter", 60),
    ("(?i)Dto|Request|Validator|Rule", 50),
)


def data_layer(id: Column) -> Column:
    """Whether the class reads or writes stored data."""
    return class_of(id).rlike(LAYER_WEIGHTS[0][0])


def layer_priority(id: Column) -> Column:
    """Weight of a callee by layer; trivial accessors weigh less."""
    weight = F.lit(20)
    for pattern, value in reversed(LAYER_WEIGHTS):
        weight = F.when(class_of(id).rlike(pattern), value).otherwise(weight)
    return weight - F.when(id.rlike(r"::(get|set|is|has|to|from|with)[A-Z_]?\w*$"), 15).otherwise(0)


# Namespace segments of architecture layers, in the order in which they are tried, with rank and common name.
LAYERS = (
    ("Infrastructure", "Infrastructure", 5, "Infrastructure"),
    ("Domain", "Domain", 4, "Domain"),
    ("Presentation", "Presentation", 0, "Controller"),
    ("Http", "Http", 0, "Controller"),
    ("Controllers?", "Controller", 0, "Controller"),
    ("UseCases", "UseCases", 1, "UseCase"),
    ("UseCase", "UseCase", 1, "UseCase"),
    ("Services", "Services", 2, "Service"),
    ("Service", "Service", 2, "Service"),
    ("Repositories", "Repositories", 3, "Repository"),
    ("Repository", "Repository", 3, "Repository"),
)


def layer_strict(id: Column) -> Column:
    """Layer by whole namespace segment."""
    out = F.lit(None).cast("string")
    for segment, key, _, _ in reversed(LAYERS):
        out = F.when(class_of(id).rlike(rf"(^|\\){segment}(\\|$)"), key).otherwise(out)
    return out


def layer_loose(id: Column) -> Column:
    """Layer by first word contained."""
    out = F.lit(None).cast("string")
    for key in reversed(("Controller", "Http", "Presentation", "UseCase", "UseCases", "Service", "Services", "Repository", "Repositories", "Domain", "Infrastructure")):
        out = F.when(class_of(id).contains(key), key).otherwise(out)
    return out


def layer_rank(layer: Column) -> Column:
    """0 (outermost) to 5."""
    # a map names its argument once, so that the patterns behind it are not tried again for each layer
    return F.element_at(F.create_map(*[F.lit(x) for _, key, rank, _ in LAYERS for x in (key, rank)]), layer)


# Directories and file names by which files are told apart.
TEST_DIRS = ("test", "tests", "__tests__", "__test__", "spec", "specs", "e2e", "cypress", "playwright", "k6", "testing")
MIGRATION_DIRS = ("migrations", "migration")
FIXTURE_DIRS = ("fixtures", "fixture", "factories", "seeders", "seeds", "stubs", "mocks", "__mocks__")
TEST_NAME = r"(^|[.\-_])(test|tests|spec|specs)\.[cm]?[jt]sx?$|(Test|TestCase|Cest|Spec)\.php$"
MIGRATION_NAME = r"^\d{4}_\d{2}_\d{2}_\d{6}_.+\.php$|^\d{4}-\d{2}-\d{2}.*\.(php|sql)$|\.sql$"


def file_role(file: Column) -> Column:
    """test, migration, fixture or source."""
    parts = F.filter(F.split(F.translate(F.coalesce(file, F.lit("")), "\\", "/"), "/"), lambda p: p != "")
    name = F.coalesce(F.element_at(F.when(F.size(parts) > 0, parts), -1), F.lit(""))
    dirs = F.transform(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), F.lower)
    within = lambda names: F.arrays_overlap(dirs, F.array(*map(F.lit, names)))
    return (
        F.when(within(TEST_DIRS) | name.rlike(TEST_NAME), "test")
        .when(within(MIGRATION_DIRS) | name.rlike(MIGRATION_NAME), "migration")
        .when(within(FIXTURE_DIRS), "fixture")
        .otherwise("source")
    )


# Patterns of test files in a stored graph, whatever their case.
TEST_PATTERNS = ("%/tests/%", "tests/%", "%/test/%", "test/%", "%/__tests__/%", "%Test.php", "%Cest.php", "%.test.%", "%.spec.%")


def test_file(file: Column) -> Column:
    """Whether a path looks like that of a test."""
    out = F.lit(False)
    for pattern in TEST_PATTERNS:
        out = out | file.ilike(pattern)
    return F.coalesce(out, F.lit(False))


# What a file's role takes off a score; what words of a label or file name add; what edges add that tie files of one feature; tiers of an impact score.
ROLE_PENALTIES = {"test": 900, "fixture": 700, "migration": 450}
SEMANTIC_BONUSES = (("query|repository|filter", 150), ("request|dto|validator", 100), ("service|usecase|action", 80), ("generator|transformer|resource", 60), ("controller", 40))
EDGE_BONUSES = (
    (("REGISTERED_AS", "RESOLVES_VIA_REGISTRY", "RENDERS_DYNAMIC"), 330),
    (("ROUTES_TO", "HTTP_REQUEST", "HANDLED_BY"), 280),
    (("CALLS", "DEPENDS_ON", "RENDERS_COMPONENT"), 210),
    (("IMPORTS", "REFERENCES"), 130),
)
OTHER_EDGE = 80
RISK_TIERS = ((40, "CRITICAL"), (20, "HIGH"), (8, "MEDIUM"))
# Roles of files in a feature, in the order in which they are tried: role, pattern of the lower-cased path (null: none), node type that also means it.
FEATURE_ROLES = (
    ("test", r"(^|/)(test|tests|__tests__)/|\.(spec|test|stories)\.[^.]+$", None),
    ("route", r"(^|/)routes?/", "route"),
    ("controller", "controller", None),
    ("service", "service", None),
    ("repository", "repositor|querybuilder|/query/", None),
    ("model", "model", None),
    ("composable", None, None),
    ("registry", "registr|componentmap|modulemap", "component_registry"),
    ("component", r"\.vue$", "vue_component"),
    ("resource", r"(^|/)(api)?resources?/(?!assets/)|resources?\.php$|serializer|transformer", None),
    ("config", r"config|\.config\.", None),
)
COMPOSABLE = "composable|/use[A-Z]"


def _first_of(rules: list[tuple[Column, object]], otherwise: object) -> Column:
    """The value of the first rule that holds."""
    out = F.lit(otherwise)
    for test, value in reversed(rules):
        out = F.when(test, value).otherwise(out)
    return out


def file_role_penalty(file: Column) -> Column:
    """How much a file's role takes off its score."""
    role = file_role(file)
    return _first_of([(role == name, value) for name, value in ROLE_PENALTIES.items()], 0)


def semantic_bonus(label: Column, file: Column) -> Column:
    """What a label and file name add to a score."""
    text = F.lower(F.concat_ws(" ", label, F.substring_index(F.coalesce(file, F.lit("")), "/", -1)))
    return _first_of([(text.rlike(pattern), value) for pattern, value in SEMANTIC_BONUSES], 0)


def feature_file_role(file: Column, types: Column) -> Column:
    """One of twelve roles that a file plays in a feature."""
    path = F.translate(file, "\\", "/")

    def holds(role: str, pattern: str | None, kind: str | None) -> Column:
        by_path = path.rlike(COMPOSABLE) if role == "composable" else F.lower(path).rlike(pattern)  # only this one minds case
        return by_path | F.array_contains(types, kind) if kind else by_path

    return _first_of([(holds(*rule), rule[0]) for rule in FEATURE_ROLES], "other")


def edge_bonus(type: Column) -> Column:
    """How strongly an edge ties two files of one feature."""
    return _first_of([(type.isin(*types), value) for types, value in EDGE_BONUSES], OTHER_EDGE)


def risk(score: Column) -> Column:
    """Tier of an impact score."""
    return _first_of([(score >= least, tier) for least, tier in RISK_TIERS], "LOW")


def risk_order(tier: Column) -> Column:
    """CRITICAL first."""
    return F.when(tier == "CRITICAL", 0).when(tier == "HIGH", 1).when(tier == "MEDIUM", 2).otherwise(3)
