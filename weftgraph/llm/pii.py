"""PII: detected entities get surrogates of the same type, gender, script and format.

One pattern finds e-mail addresses, phone numbers (international, and of the form 555-123-4567), card and social security numbers,
IPv4 and IPv6 addresses, IBANs, secrets (long hexadecimal strings, keys of known prefixes, what follows words such as
`password=`), and person names: those with a title, and those that begin with a known given name. An entity's identity is
its canonical form (digits of a number, lower case of an address), so that it gets one surrogate wherever and however it is
written, and each mention is rendered in its own format. Of a person the given names and the family name are entities of
their own: `Mr Smith`, `Dr John Smith` and `John Smith` stay one person, and a name keeps its number of parts. A given name has the
gender that most of its titles say, or else that of the known name.

Surrogates come from a keyed hash: letters for letters and digits for digits, valid check digits for cards and IBANs, valid
octets for addresses, names by gender and script. A surrogate that another entity already has, or that is itself an
entity of the corpus, is drawn again. From draw `DRAWS` on (names from the second on) surrogates get longer with each draw,
so every set of entities comes to an end, also where a shape has no other form (`_@-.com`) or all its forms are taken.

All of it is column expressions. Texts are read once to find mentions, which are written down, and once to put surrogates
in, joined by document. Only mentions and distinct entities are grouped. A mention in very many documents is one row of the
surrogate table; Spark splits its side of the join if it is skewed.

Names may have inner capitals (McDonald), apostrophes (O'Brien, d'Arc), hyphens, initials, and particles (van der Berg), which belong to the family name
that follows. Latin, Cyrillic, Greek and Armenian names get names of their own script. A name ends before words that begin sentences
(The, Der, Il and others); other capitalised words after it count as its parts, up to three.

Not detected: names without a title and without a known given name, names in capitals only or in scripts without case (Arabic, Chinese, Georgian and others), names behind other
titles. Names in other scripts with case get Latin ones, and family names don't follow the gender. Nor are found: postal addresses, dates of birth, national phone forms other
than the one above, other identity documents, and secrets without a prefix or key word that aren't hexadecimal.

Null texts stay null and hold no entities. Rows with null or repeated ids, and repeated rows, are each replaced; an empty table
gives an empty result. A column named n_entities gives way to the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import checkpointed, written

#: Draws after which a surrogate is made longer (of names there are few, so those grow from the second draw on).
DRAWS = 4
MALE, FEMALE = "Mr|Herr|Monsieur|Señor|Sr|Signor|г-н|Κύριος", "Mrs|Ms|Miss|Frau|Madame|Mme|Señora|Sra|Signora|г-жа|Κυρία"
TITLES = f"{MALE}|{FEMALE}|Dr|Prof"
#: Given and family names by script and gender: fixed lists.
NAMES = {
    "latin": {
        "male": "Adrian Bruno Carl David Emil Felix Gabriel Hugo Ivan Jonas Karl Leo Martin Noah Oscar Paul Robert Simon Tom Victor".split(),
        "female": "Alice Beatrice Clara Diana Emma Flora Greta Helen Irene Julia Karla Laura Maria Nora Olga Paula Rosa Sofia Teresa Vera".split(),
        "family": "Adler Berger Costa Duval Ernst Fontana Garcia Hansen Ibsen Jansen Keller Lambert Moreau Novak Olsen Petit Rossi Santos Torres Weber".split(),
    },
    "cyrillic": {
        "male": "Алексей Борис Виктор Глеб Денис Егор Иван Кирилл Лев Максим".split(),
        "female": "Анна Вера Галина Дарья Елена Ирина Ксения Лидия Мария Нина".split(),
        "family": "Белов Волков Громов Дроздов Ершов Жуков Зимин Козлов Лебедев Морозов".split(),
    },
    "greek": {
        "male": "Αλέξανδρος Βασίλης Γιάννης Δημήτρης Ηλίας Κώστας Λάμπρος Μιχάλης Νίκος Πέτρος".split(),
        "female": "Αθηνά Βασιλική Γεωργία Δήμητρα Ελένη Ιωάννα Κατερίνα Μαρία Σοφία Χριστίνα".split(),
        "family": "Αντωνίου Βλάχος Γεωργίου Δημητρίου Ιωάννου Κωνσταντίνου Λάμπρου Νικολάου Παππάς Σταύρου".split(),
    },
    "armenian": {
        "male": "Արամ Արմեն Գարիկ Դավիթ Հայկ Կարեն Նարեկ Սուրեն Տիգրան Վահան".split(),
        "female": "Անահիտ Անի Արփի Գայանե Լիլիթ Լուսինե Մարիամ Նարե Նունե Շուշան".split(),
        "family": "Աբրահամյան Գրիգորյան Դավթյան Հակոբյան Մարտիրոսյան Ներսիսյան Պետրոսյան Սարգսյան Վարդանյան Օհանյան".split(),
    },
}
#: Given names that mark a name without a title, by gender: those above and common others.
KNOWN = {
    "male": [*(n for names in NAMES.values() for n in names["male"]), *"John James Michael William Richard Joseph Thomas Charles Peter Hans Klaus Pierre Jean Luis Carlos José Juan Pablo Luca Marco Giovanni Александр Сергей Дмитрий".split()],
    "female": [*(n for names in NAMES.values() for n in names["female"]), *"Mary Jennifer Linda Elizabeth Susan Sarah Karen Anna Erika Ursula Sabine Marie Camille Isabelle Carmen Lucía Ana Giulia Chiara Francesca Ольга Татьяна Наталья".split()],
}
#: Words that a secret follows, and prefixes of keys.
WORDS = r"(?i:pass(?:word|wd|phrase)|pwd|secret|(?:access|auth)[_-]?token|token|(?:api|access|private)[_-]?key)[\"']?[ \t]?[=:][ \t]?[\"']?"
PREFIXES = r"AKIA(?=[0-9A-Z]{16})|[sprk]k[-_](?=[A-Za-z0-9_-]{16})|gh[pousr]_(?=[A-Za-z0-9]{20})|xox[abpr]-(?=[A-Za-z0-9-]{10})|AIza(?=[0-9A-Za-z_-]{35})"
#: Lower-case words of family names, and capitalised ones that begin a sentence after a name.
PARTICLES = "van von vom der den de del della di da dos du ten ter zu zur bin ibn af av".split()
NO_NAMES = (
    "The This That These Those He She It We They You His Her Their But And Then When After Before If In On At"
    " Der Die Das Den Dem Ein Eine Er Sie Es Wir Ihr Und Aber Dann Wenn Als Im Am Le La Les Un Une Il Elle Ils Elles Nous Vous Et Mais Puis Quand"
    " El Los Las Una Ella Ellos Nosotros Pero Cuando Entonces Lo Gli Uno Lui Lei Noi Voi Loro Ma Quando Он Она Они Мы Вы Это Но Когда Потом"
).split()
_WORD = r"(?:\p{Lu}['’])?\p{Lu}\p{Ll}++(?:\p{Lu}\p{Ll}++)*+(?:['’]\p{L}\p{Ll}++)?+"
_NAME = rf"(?!(?:{'|'.join(NO_NAMES)})(?![\p{{L}}'’-]))(?:(?:{'|'.join(PARTICLES)}) ){{0,3}}+(?:[dl]['’])?{_WORD}(?:-{_WORD})*+"
_INITIALS = r"(?:\p{Lu}\. ?(?=\p{Lu})){0,3}+"
_HEX4 = "[0-9A-Fa-f]{1,4}"
# Each branch looks at one character first, so that most places cost little.
PATTERN = "|".join(
    [
        r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        rf"(?=[PpSsTtAa])(?<![A-Za-z]){WORDS}[A-Za-z0-9+/_.=!@#$%^&*-]{{6,}}+",
        rf"(?=[Asprkgx])(?<![A-Za-z0-9])(?:{PREFIXES})[A-Za-z0-9_-]++",
        r"(?=[0-9A-Fa-f])(?<![0-9A-Za-z])(?:[0-9a-f]{32,}+|[0-9A-F]{32,}+)(?![0-9A-Za-z])",
        rf"(?=[0-9A-Fa-f])(?<![0-9A-Za-z:.])(?:(?:{_HEX4}:){{7}}{_HEX4}|(?=[A-Fa-f:]*[0-9])(?:{_HEX4}:){{1,6}}(?::{_HEX4}){{1,6}})(?![0-9A-Za-z:])",
        r"(?=[0-9])(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![0-9]|\.[0-9])",
        r"(?=[A-Z])(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])",
        r"\+[0-9]{1,3}[ .-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})(?:[ .-]?[0-9]{2,4}){2,3}(?![0-9])",
        r"(?=[(0-9])(?<![0-9A-Za-z.(+-])(?:\([0-9]{3}\) ?[0-9]{3}[ .-]|[0-9]{3}[.-][0-9]{3}[.-])[0-9]{4}(?![0-9-])",
        r"(?=[0-9])(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
        r"(?=[0-9])(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])",
        rf"(?=[MHSFDPгΚ])(?<!\p{{L}})(?:{TITLES})\.? {_INITIALS}{_NAME}(?: {_INITIALS}{_NAME}){{0,2}}",
        rf"(?=\p{{Lu}})(?<!\p{{L}})(?:{'|'.join(dict.fromkeys([*KNOWN['male'], *KNOWN['female']]))}) {_INITIALS}{_NAME}(?: {_NAME})?",
    ]
)


def _words(words: list[str]) -> str:
    return "array(" + ", ".join(f"'{w}'" for w in words) + ")"


def _kind(v: str) -> str:
    return (
        f"CASE WHEN {v} RLIKE r'^(?:{_sql(WORDS)}|{PREFIXES})' THEN 'secret' WHEN {v} LIKE '%@%' THEN 'email'"
        f" WHEN {v} RLIKE '^[0-9a-fA-F]{{32,}}$' AND {v} RLIKE '[a-fA-F]' THEN 'secret'"
        f" WHEN {v} LIKE '%:%' THEN 'ipv6' WHEN {v} RLIKE r'^[0-9]{{1,3}}(\\.[0-9]{{1,3}}){{3}}$' THEN 'ip' WHEN {v} RLIKE '^[A-Z]{{2}}[0-9]{{2}}' THEN 'iban'"
        f" WHEN {v} RLIKE r'^[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}$' THEN 'ssn' WHEN {v} RLIKE r'^(?:[+(]|[0-9]{{3}}[.-][0-9]{{3}}[.-][0-9]{{4}}$)' THEN 'phone'"
        f" WHEN {v} RLIKE '^[0-9]' THEN 'card' ELSE 'person' END"
    )


def _sql(pattern: str) -> str:
    """For an r'...' literal: no quote may stand in it."""
    return pattern.replace("'", r"\x27")


def _identity(kind: str, v: str) -> str:
    """The canonical form of an entity other than a name. A number of the form 555-123-4567 is that of country 1."""
    digits = f"regexp_replace({v}, '[^0-9]', '')"
    return (
        f"CASE WHEN {kind} = 'phone' AND {v} NOT LIKE '+%' THEN concat('1', {digits}) WHEN {kind} IN ('phone', 'ssn', 'card') THEN {digits}"
        f" WHEN {kind} = 'iban' THEN replace({v}, ' ', '') WHEN {kind} = 'secret' AND NOT {v} RLIKE '^(?:[0-9a-f]+|[0-9A-F]+)$' THEN {v} ELSE lower({v}) END"
    )


def _shaped(of: str, letters: str) -> str:
    """Letters for letters and digits for digits, drawn from the keyed hash `h`."""
    c = f"substr({of}, i, 1)"
    pick = f"substr('{letters}', cast(pmod(xxhash64(h, i), {len(letters)}) AS int) + 1, 1)"
    return (
        f"array_join(transform(sequence(1, length({of})), i -> CASE WHEN length({of}) = 0 THEN '' WHEN {c} RLIKE '[0-9]' THEN cast(pmod(xxhash64(h, i), 10) AS string)"
        f" WHEN {c} RLIKE '[a-z]' THEN {pick} WHEN {c} RLIKE '[A-Z]' THEN upper({pick}) ELSE {c} END), '')"
    )


def _more(alphabet: str) -> str:
    """What makes a surrogate longer: one more character with each draw from DRAWS on."""
    return f"CASE WHEN draw < {DRAWS} THEN '' ELSE array_join(transform(sequence({DRAWS}, draw), i -> substr('{alphabet}', cast(pmod(xxhash64(h, 'more', i), {len(alphabet)}) AS int) + 1, 1)), '') END"


def _name(script: str) -> str:
    lists = NAMES[script]
    both = {"male": lists["male"], "female": lists["female"], "any": lists["male"] + lists["female"], "family": lists["family"]}
    # With every draw there is one more name to choose, so there are always enough.
    pick = lambda words: f"array_join(transform(sequence(0, draw), k -> element_at({_words(words)}, cast(pmod(xxhash64(h, k), {len(words)}) AS int) + 1)), '-')"
    cases = " ".join(f"WHEN {'kind' if g == 'family' else 'gender'} = '{g}' THEN {pick(w)}" for g, w in sorted(both.items(), key=lambda x: x[0] != "family"))
    return f"CASE {cases} END"


def _of_script(script: str) -> str:
    return f"WHEN identity RLIKE r'\\p{{Is{script.capitalize()}}}' THEN {_name(script)}"


def _luhn(body: str) -> str:
    """The check digit of a number."""
    d = f"cast(substr({body}, length({body}) - i, 1) AS int)"
    return f"cast(pmod(-aggregate(sequence(0, length({body}) - 1), 0, (a, i) -> a + CASE WHEN i % 2 = 0 THEN {d} * 2 - CASE WHEN {d} > 4 THEN 9 ELSE 0 END ELSE {d} END), 10) AS string)"


def _iban(country: str, body: str) -> str:
    """An IBAN with its check digits: what makes the rearranged number 1 modulo 97."""
    c = "substr(b, i, 1)"
    rest = f"aggregate(sequence(1, length(b)), 0, (a, i) -> CASE WHEN {c} RLIKE '[0-9]' THEN (a * 10 + cast({c} AS int)) % 97 ELSE (a * 100 + ascii({c}) - 55) % 97 END)"
    return f"concat({country}, transform(array(concat({body}, {country}, '00')), b -> lpad(cast(98 - {rest} AS string), 2, '0'))[0], {body})"


def _surrogate() -> str:
    """SQL over kind, identity, gender, draw and the keyed hash h."""
    low, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    local, rest = "regexp_extract(identity, r'^([^@]*)(@.*)$', 1)", r"regexp_extract(identity, r'^([^@]*)(@.*?)((?:\.[^.]*)?)$', {})"
    known = f"regexp_extract(identity, r'^(?:{PREFIXES})', 0)"
    body = f"substr(identity, length({known}) + 1)"
    card = f"concat({_shaped('substr(identity, 2, length(identity) - 2)', 'abcdef')}, {_more(digits)})"
    account = f"concat({_shaped('substr(identity, 5)', low)}, {_more(digits)})"
    return (
        "CASE kind"
        f" WHEN 'email' THEN concat({_shaped(local, low)}, {_more(low)}, {_shaped(rest.format(2), low)}, {rest.format(3)})"
        f" WHEN 'secret' THEN concat({known}, CASE WHEN identity RLIKE '^[0-9a-f]+$' THEN {_shaped('identity', 'abcdef')} ELSE {_shaped(body, low)} END, {_more('0123456789abcdef')})"
        f" WHEN 'ip' THEN concat(array_join(transform(sequence(1, 4), i -> cast(pmod(xxhash64(h, i), 254) + 1 AS string)), '.'), CASE WHEN draw < {DRAWS} THEN '' ELSE concat(':', {_more(digits)}) END)"
        f" WHEN 'ipv6' THEN concat({_shaped('identity', 'abcdef')}, CASE WHEN draw < {DRAWS} THEN '' ELSE concat('%', {_more(low)}) END)"
        f" WHEN 'iban' THEN {_iban('substr(identity, 1, 2)', account)}"
        f" WHEN 'phone' THEN concat(substr(identity, 1, 1), {_shaped('substr(identity, 2)', 'abcdef')}, {_more(digits)})"
        f" WHEN 'ssn' THEN concat({_shaped('identity', 'abcdef')}, {_more(digits)})"
        f" WHEN 'card' THEN transform(array(concat(substr(identity, 1, 1), {card})), b -> concat(b, {_luhn('b')}))[0]"
        f" ELSE CASE {' '.join(_of_script(s) for s in NAMES if s != 'latin')} ELSE {_name('latin')} END END"
    )


def _rendered(v: str, kind: str, s: str) -> str:
    """The surrogate in the format of this mention; where it is longer, the rest follows."""
    own = f"CASE WHEN {kind} = 'phone' AND {v} NOT LIKE '+%' THEN substr({s}, 2) ELSE {s} END"
    filled = lambda keep, to: (  # noqa: E731  one pass over the mention: text so far, and how much of the surrogate is used
        f"transform(array({to}), o -> aggregate(sequence(1, length({v})), named_struct('t', '', 'n', 0),"
        f" (a, i) -> CASE WHEN substr({v}, i, 1) RLIKE '{keep}' THEN named_struct('t', concat(a.t, substr(o, a.n + 1, 1)), 'n', a.n + 1) ELSE named_struct('t', concat(a.t, substr({v}, i, 1)), 'n', a.n) END,"
        f" a -> concat(a.t, substr(o, a.n + 1))))[0]"
    )
    cased = f"CASE WHEN {v} = lower({v}) THEN {s} ELSE array_join(transform(sequence(1, length({s})), i -> CASE WHEN substr({v}, i, 1) RLIKE '[A-Z]' THEN upper(substr({s}, i, 1)) ELSE substr({s}, i, 1) END), '') END"
    hexadecimal = f"CASE WHEN {v} RLIKE '^[0-9A-F]+$' THEN upper({s}) ELSE {s} END"
    return f"CASE WHEN {kind} IN ('phone', 'ssn', 'card') THEN {filled('[0-9]', own)} WHEN {kind} = 'iban' THEN {filled('[0-9A-Z]', s)} WHEN {kind} = 'email' THEN {cased} WHEN {kind} = 'secret' THEN {hexadecimal} WHEN {kind} = 'ipv6' THEN CASE WHEN {v} = upper({v}) THEN upper({s}) ELSE {s} END ELSE {s} END"


#: Between the parts of a name: a space, but not one after a particle.
_BREAK = rf"(?<!(?:^| )(?:{'|'.join(PARTICLES)})) "


def mentions(docs: DataFrame) -> DataFrame:
    """(_id, _hash, at, k, before, value, kind, identity, gender): every mention of every document, of names each part (k); `before` stays as it is."""
    found = docs.select(F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_hash"), F.posexplode_outer(F.regexp_extract_all(F.col("text"), F.lit(PATTERN), F.lit(0))).alias("at", "all")).where("all IS NOT NULL")
    each = found.withColumn("kind", F.expr(_kind("all")))
    fixed = f"CASE kind WHEN 'secret' THEN regexp_extract(all, r'^{_sql(WORDS)}', 0) WHEN 'person' THEN regexp_extract(all, r'^(?:{TITLES})\\.? ', 0) ELSE '' END"
    each = each.withColumn("fixed", F.expr(fixed)).withColumn("value", F.expr("substr(all, length(fixed) + 1)"))
    gender = f"CASE WHEN kind <> 'person' THEN NULL WHEN fixed RLIKE r'^(?:{MALE})\\b' THEN 'male' WHEN fixed RLIKE r'^(?:{FEMALE})\\b' THEN 'female' END"
    part = "struct(k, CASE WHEN k = 0 THEN fixed ELSE ' ' END AS before, p AS value, CASE WHEN k = size(w) - 1 THEN 'family' ELSE 'given' END AS kind, translate(lower(p), '’', chr(39)) AS identity)"
    whole = f"array(struct(0 AS k, fixed AS before, value, kind, {_identity('kind', 'value')} AS identity))"
    parts = F.expr(f"CASE WHEN kind = 'person' THEN transform(array(split(value, r'{_BREAK}')), w -> transform(w, (p, k) -> {part}))[0] ELSE {whole} END")
    return each.select("_id", "_hash", "at", F.expr(gender).alias("gender"), F.explode(parts).alias("p")).select("_id", "_hash", "at", "p.*", "gender")


def entities(found: DataFrame) -> DataFrame:
    """Distinct (kind, identity, gender): a given name has the gender that most of its titles say, or else that of the known name."""
    votes = F.sum(F.when(F.col("gender") == "male", 1).when(F.col("gender") == "female", -1).otherwise(0))
    known = lambda g: F.col("identity").isin([w.lower() for w in KNOWN[g]])
    gender = F.when(F.col("v") > 0, "male").when(F.col("v") < 0, "female").when(known("male"), "male").when(known("female"), "female").otherwise("any")
    return found.groupBy("kind", "identity").agg(votes.alias("v")).select("kind", "identity", gender.alias("gender"))


def surrogates(entities: DataFrame, secret: str) -> DataFrame:
    """(kind, identity, surrogate) for distinct (kind, identity, gender): no two entities of a kind share one, and none is an entity itself."""
    todo, done, draw = checkpointed(entities.select("kind", "identity", "gender")), None, 0
    real = todo.select("kind", F.col("identity").alias("_s"))
    while True:
        h = F.sha2(F.concat_ws("\u0001", F.lit(secret), "kind", "identity", F.lit(str(draw))), 256)
        drawn = todo.withColumn("h", h).withColumn("draw", F.lit(draw)).select("kind", "identity", F.expr(_surrogate()).alias("surrogate"))
        compare = drawn.withColumn("_s", F.when(F.col("kind").isin("secret", "iban"), F.col("surrogate")).otherwise(F.lower("surrogate"))).join(real, ["kind", "_s"], "left_anti").drop("_s")
        if done is not None:
            compare = compare.join(done.select("kind", "surrogate"), ["kind", "surrogate"], "left_anti")
        # of several that drew the same, the first keeps it
        first = compare.groupBy("kind", "surrogate").agg(F.min("identity").alias("identity")).select("kind", "identity", "surrogate")
        done = checkpointed(first if done is None else done.unionByName(first))
        todo = checkpointed(todo.join(done, ["kind", "identity"], "left_anti"))
        draw += 1
        if todo.isEmpty():
            return done


def replace(docs: DataFrame, secret: str) -> DataFrame:
    """All columns of `docs` with surrogates in text, and n_entities. `secret` is the key: who has it can find what a surrogate stands for."""
    kept = [c for c in docs.columns if c != "n_entities"]
    found = written(mentions(docs))
    table = surrogates(entities(found), secret)
    put = found.join(table, ["kind", "identity"]).select("_id", "_hash", "at", "k", F.concat("before", F.expr(_rendered("value", "kind", "surrogate"))).alias("new"))
    whole = put.distinct().groupBy("_id", "_hash", "at").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "new"))), lambda x: x["new"]), "").alias("new"))
    by_doc = whole.groupBy(F.col("_id").alias("_weft_id"), F.col("_hash").alias("_weft_hash")).agg(F.array_sort(F.collect_list(F.struct("at", "new"))).alias("_weft_new"))
    rows = docs.withColumn("_weft_own", F.xxhash64("text"))
    joined = rows.join(by_doc, F.col("doc_id").eqNullSafe(F.col("_weft_id")) & (F.col("_weft_own") == F.col("_weft_hash")), "left")
    between = F.split(F.col("text"), PATTERN, -1)
    text = F.when(F.col("_weft_new").isNull(), F.col("text")).otherwise(_joined(between, F.col("_weft_new.new")))
    return joined.select(*[text.alias("text") if c == "text" else F.col(f"`{c}`") for c in kept], F.coalesce(F.size("_weft_new"), F.lit(0)).cast("long").alias("n_entities"))


def _joined(between: Column, new: Column) -> Column:
    """The pieces of a text with the new mentions between them."""
    return F.array_join(F.flatten(F.zip_with(between, new, lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))), "")


def report(docs: DataFrame, secret: str) -> DataFrame:
    """doc_id, n_entities and the replaced text of every document."""
    return replace(docs.select("doc_id", "text"), secret).select("doc_id", "n_entities", "text")
