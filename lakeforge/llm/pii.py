"""Personal data replaced by surrogates, in DataFrame functions only.

Kinds: e-mail addresses, payment cards, IBANs, IPv4 and IPv6 addresses, social security numbers, telephone
numbers, and names behind a title.

1. ``mentions`` finds the entities of each text with one regular expression and gives each a
   canonical form: the same number in two formats, or an address in two cases, is one entity. A
   name is one entity a word, whatever the title, so "Dr Jan Roth", "Mr Jan Roth" and "Mr Roth" share surrogates.
2. ``surrogates`` draws a replacement for each distinct entity from a keyed hash: digits for
   digits, letters for letters in the same script, cards that keep their issuer's digit and pass or fail the
   check sum as before, addresses below reserved domains, social security numbers that could be issued. A name word that stands
   before others more often than last is a given name; its surrogate has the gender of its titles over the
   whole corpus, or either if these disagree or don't tell.
3. Collisions are checked over the whole corpus: a surrogate that another entity of its kind has,
   or that is itself an entity of the corpus, is drawn again with the next attempt's hash. Later attempts draw
   names and e-mail addresses from larger spaces. Where a kind fills its space, so that ATTEMPTS draws leave some entities over,
   these take each other's places in a ring. Different entities of a kind stay different.
4. ``replace`` puts the surrogates into the texts in each mention's own format and case, and into other
   mentions of the same document's name words without a title.

Entities meet by their canonical forms, of which each has one row, and winners of a draw by an aggregation, so no key is hot.
A document is known by doc_id and a hash of its text, so repeated rows get the same result. Null
text stays null; a null doc_id is a value of its own. Other columns are carried in a struct and may have any name.
A name that no title ever introduces in its document isn't found.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace

KEY = "lakeforge surrogate key"
ATTEMPTS = 16

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
#: Titles before names, in the order masculine, feminine, either.
TITLES = (
    ("Mr", "Herr", "Monsieur", "Señor", "господин", "г-н", "κύριος"),
    ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "госпожа", "г-жа", "κυρία"),
    ("Dr", "Prof"),
)
_TITLE = "|".join(x for group in TITLES for x in group)
_NAME = r"\p{Lu}[\p{L}'’-]+"
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)+",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{4}){3,7}(?:[ ]?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "card": r"(?<![0-9A-Za-z])(?:[0-9]{4}[ -]?){3}[0-9]{4}(?![0-9A-Za-z])",
    "ipv6": r"(?<![0-9A-Za-z:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6}|(?:[0-9A-Fa-f]{1,4}:){2,7}:|::(?:[0-9A-Fa-f]{1,4}:){1,6}[0-9A-Fa-f]{1,4})(?![0-9A-Za-z:])",
    "ip": rf"(?<![0-9.])(?:{_OCTET}\.){{3}}{_OCTET}(?![0-9]|\.[0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": r"(?<![0-9A-Za-z+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)|[0-9]{2,4})[ .-]?[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9A-Za-z])"
    r"|(?<![0-9A-Za-z+])\+[0-9]{8,15}(?![0-9A-Za-z])"
    r"|(?<![0-9A-Za-z+])\+[0-9]{1,3}(?:[ .-]?\(0\))?(?:[ .-][0-9]{1,8}){2,6}(?![0-9A-Za-z])"
    r"|(?<![0-9A-Za-z+.-])0[1-9](?:[ .-]?[0-9]{2}){4}(?![0-9A-Za-z]|[.-][0-9])"
    r"|(?<![0-9A-Za-z+.-])0[1-9][0-9]{1,3}[ /-][0-9]{5,8}(?![0-9A-Za-z]|[.-][0-9])",
    "name": rf"(?<![\p{{L}}])(?:{_TITLE})\.?[ ]{_NAME}(?:[ ]{_NAME}){{0,2}}",
}
ENTITY = "|".join(PATTERNS.values())

#: Names to draw from, by script and gender.
GIVEN = {
    "latin_m": "Adrian Bruno Carlo David Emil Felix Georg Hugo Ivan Jonas Karl Leon Marco Nils Oscar Paul Robin Simon Thomas Viktor".split(),
    "latin_f": "Alba Berta Clara Diana Elena Flora Greta Hanna Irene Julia Karin Laura Maria Nina Olga Paula Rosa Sofia Tania Vera".split(),
    "cyrillic_m": "Антон Борис Виктор Глеб Денис Егор Захар Игорь Кирилл Леонид".split(),
    "cyrillic_f": "Алла Вера Галина Дарья Елена Жанна Зоя Ирина Ксения Лидия".split(),
    "greek_m": "Άρης Γιώργος Δημήτρης Ηλίας Κώστας Λάμπρος Μάριος Νίκος Πέτρος Σπύρος".split(),
    "greek_f": "Άννα Βάσω Γεωργία Δήμητρα Ελένη Ζωή Ιωάννα Κατερίνα Μαρία Σοφία".split(),
}
#: Syllables of family names, by script.
SYLLABLES = {
    "latin": "ba ber da del fa fen ga gor ha hil ka kel la len ma mer na nor pa per ra ron sa sel ta ton va vel za zin".split(),
    "cyrillic": "ба бер да дел фа ган ко кел ла лен ма мер на нор па пер ра рон са сел та тон ва вел".split(),
    "greek": "βα γα δα θε κα κο λα λε μα με να νο πα πε ρα ρο σα σε τα το φα χα".split(),
}


def _quoted(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _array(items: list[str]) -> str:
    return "array(" + ", ".join(map(_quoted, items)) + ")"


_KIND = (
    "case when x like '%@%' then 'email'"
    f" when x rlike {_quoted('^(?:' + _TITLE + ')[. ]')} then 'name'"
    f" when x rlike {_quoted('^[A-Z]{2}[0-9]{2}')} then 'iban'"
    f" when x rlike {_quoted(r'^[0-9A-Fa-f]*:[0-9A-Fa-f:]+$')} then 'ipv6'"
    f" when x rlike {_quoted(r'^[0-9]{1,3}([.][0-9]{1,3}){3}$')} then 'ip'"
    f" when x rlike {_quoted(r'^[0-9]{3}-[0-9]{2}-[0-9]{4}$')} then 'ssn'"
    f" when x rlike {_quoted(r'^([0-9]{4}[ -]?){3}[0-9]{4}$')} then 'card' else 'phone' end"
)
_GENDER = f"case when x rlike {_quoted('^(?:' + '|'.join(TITLES[0]) + ')[. ]')} then 'm' when x rlike {_quoted('^(?:' + '|'.join(TITLES[1]) + ')[. ]')} then 'f' else 'e' end"


def _version(text: str = "text") -> Column:
    return F.xxhash64(text)


def mentions(docs: DataFrame) -> DataFrame:
    """(id, version, place, part, kind, canon, form, gender, role) of each entity of each text: ``form`` is as it stands there, role of a name word given, family, or empty for a word by itself."""
    found = docs.select(F.col("doc_id").alias("id"), _version().alias("version"), F.posexplode(F.regexp_extract_all("text", F.lit(ENTITY), F.lit(0))).alias("place", "x"))
    kinds = found.select("id", "version", "place", "x", F.expr(_KIND).alias("kind"), F.expr(_GENDER).alias("gender"))
    words = "filter(split(x, ' '), (w, i) -> i > 0)"
    one = lambda canon: f"array(named_struct('canon', {canon}, 'form', x, 'role', ''))"
    parts = (
        f"case when kind = 'name' then transform({words}, (w, i) -> named_struct('canon', lower(w), 'form', w, 'role', case when size({words}) = 1 then '' when i = size({words}) - 1 then 'family' else 'given' end))"
        f" when kind in ('email', 'ipv6') then {one('lower(x)')}"
        f" when kind = 'ip' then {one('x')}"
        " when kind = 'iban' then " + one("replace(x, ' ', '')") + " else " + one("regexp_replace(x, '[^0-9]', '')") + " end"
    )
    return kinds.select("id", "version", "place", "kind", "gender", F.posexplode(F.expr(parts)).alias("part", "p")).select("id", "version", "place", "part", "kind", "p.canon", "p.form", "gender", "p.role")


def _draw(attempt: int, key: str) -> str:
    """SQL for the surrogate of (kind, canon), canonical itself; ``form`` is one of its forms, for the country code of telephone numbers, ``given`` and ``gender`` are a name's."""
    h = "concat(" + ", ".join(f"sha2(concat({_quoted(key)}, '|', kind, '|', canon, '|{attempt}|{k}'), 256)" for k in range(4)) + ")"
    byte = lambda i: f"cast(conv(substring(h, 2 * pmod({i}, 128) + 1, 2), 16, 10) as int)"
    letter = lambda alphabet: f"substring('{alphabet}', 1 + {byte('i')} % {len(alphabet)}, 1)"
    # Characters in place: letters for letters of the script, digits for digits; later attempts add a letter each.
    like = lambda s: (
        f"array_join(transform(split({s}, ''), (c, i) -> case when c rlike '[0-9]' then cast({byte('i')} % 10 as string) when c rlike '[A-Z]' then chr(65 + {byte('i')} % 26)"
        f" when c rlike '\\\\p{{IsCyrillic}}' then {letter('абвгдежзиклмнопрстуфхцчшэюя')} when c rlike '\\\\p{{IsGreek}}' then {letter('αβγδεζηθικλμνξοπρστυφχψω')} when c rlike '\\\\p{{L}}' then chr(97 + {byte('i')} % 26) else c end), '')"
    )
    more = "".join(f", chr(97 + {byte(100 + k)} % 26)" for k in range(max(0, attempt - 1)))
    host = f"concat(chr(97 + {byte(60)} % 26), chr(97 + {byte(61)} % 26), chr(97 + {byte(62)} % 26), chr(97 + {byte(63)} % 26), '.example.org')"
    email = f"concat({like('split_part(canon, ' + _quoted('@') + ', 1)')}{more}, '@', {host})"
    iban = f"concat(substring(canon, 1, 2), {like('substring(canon, 3)')})"
    start = f"concat(substring(canon, 1, 1), substring({like('canon')}, 2, length(canon) - 2))"
    card = f"concat({start}, cast(element_at(filter(sequence(0, 9), d -> luhn_check(concat({start}, cast(d as string))) = luhn_check(canon)), 1 + {byte(64)} % if(luhn_check(canon), 1, 9)) as string))"
    ip = f"concat_ws('.', cast(1 + {byte(0)} % 223 as string), cast({byte(1)} as string), cast({byte(2)} as string), cast(1 + {byte(3)} % 254 as string))"
    ipv6 = "concat('2001:db8', " + ", ".join(f"':', substring(h, {1 + 4 * k}, 4)" for k in range(6)) + ")"
    wide = lambda at: f"({byte(at)} * 256 + {byte(at + 1)})"
    ssn = f"concat(lpad(1 + {wide(70)} % 665, 3, '0'), lpad(1 + {byte(72)} % 99, 2, '0'), lpad(1 + {wide(73)} % 9999, 4, '0'))"
    # A country code stays, and so does the zero of a national number.
    code = r"if(form like '0%', 1, length(regexp_replace(regexp_extract(form, '^\\+[0-9]{1,3}(?=[ .(-])', 0), '[^0-9]', '')))"
    phone = f"concat(substring(canon, 1, {code}), cast(2 + {byte(70)} % 8 as string), substring({like('canon')}, {code} + 2))"
    script = lambda d: f"case when canon rlike '\\\\p{{IsCyrillic}}' then {d('cyrillic')} when canon rlike '\\\\p{{IsGreek}}' then {d('greek')} else {d('latin')} end"
    pick = lambda a, at: f"element_at({_array(a)}, 1 + {wide(at)} % {len(a)})"

    def given(gender: str):
        # One name, or as many as there were attempts, hyphenated.
        names = lambda s: (GIVEN[f"{s}_m"] + GIVEN[f"{s}_f"]) if gender == "e" else GIVEN[f"{s}_{gender}"]
        return lambda s: "lower(concat_ws('-', " + ", ".join(pick(names(s), 4 * k) for k in range(attempt + 1)) + "))"

    def family(s: str) -> str:
        return "concat(" + ", ".join(pick(SYLLABLES[s], 4 * k) for k in range(3 + attempt)) + ")"

    name = f"case when not given then {script(family)} when gender = 'm' then {script(given('m'))} when gender = 'f' then {script(given('f'))} else {script(given('e'))} end"
    cases = {"email": email, "iban": iban, "card": card, "ip": ip, "ipv6": ipv6, "ssn": ssn, "phone": phone, "name": name}
    body = "case kind " + " ".join(f"when '{k}' then {v}" for k, v in cases.items()) + " end"
    # h is bound once for all its uses.
    return f"element_at(transform(array({h}), h -> {body}), 1)"


def entities(found: DataFrame) -> DataFrame:
    """(kind, canon, form, given, gender): one row an entity."""
    count = lambda role: F.sum(F.when(F.col("role") == role, 1).otherwise(0))
    seen = lambda gender: F.max(F.col("gender") == gender)
    gender = F.when(seen("m") & ~seen("f"), "m").when(seen("f") & ~seen("m"), "f").otherwise("e")
    return found.groupBy("kind", "canon").agg(F.min("form").alias("form"), (count("given") > count("family")).alias("given"), gender.alias("gender"))


def surrogates(found: DataFrame, ws: Workspace, key: str = KEY, *, attempts: int = ATTEMPTS) -> DataFrame:
    """(kind, canon, surrogate): distinct for distinct entities of a kind, and none of them an entity of the corpus but where a kind fills its space."""
    every = ws.write(entities(found), "entities")
    known = every.select("kind", F.col("canon").alias("drawn"))
    todo, done = every, None
    for attempt in range(attempts):
        drawn = todo.withColumn("drawn", F.expr(_draw(attempt, key)))
        # Of those that drew the same the least has it; each draw then has one row.
        won = drawn.groupBy("kind", "drawn").agg(F.min("canon").alias("canon")).join(known.hint("merge"), ["kind", "drawn"], "left_anti")
        if done is not None:
            won = won.join(done.select("kind", F.col("surrogate").alias("drawn")).hint("merge"), ["kind", "drawn"], "left_anti")
        good = ws.write(won.select("kind", "canon", F.col("drawn").alias("surrogate")), f"drawn-{attempt}")
        done = good if done is None else done.union(good)
        todo = ws.write(todo.join(good.select("kind", "canon").hint("merge"), ["kind", "canon"], "left_anti"), f"todo-{attempt}")
        if attempt:
            ws.drop(f"todo-{attempt - 1}")
        if todo.isEmpty():
            return done
    ring = Window.partitionBy("kind", F.length("canon")).orderBy(F.sha2(F.concat(F.lit(key), "canon"), 256), "canon")
    head = F.first("canon").over(ring.rowsBetween(Window.unboundedPreceding, 0))
    return done.union(todo.select("kind", "canon", F.coalesce(F.lead("canon").over(ring), head).alias("surrogate")))


#: A mention in its own format: ``o`` as it stands in the text, ``s`` the surrogate.
_FILL = (
    "aggregate(split(o, ''), named_struct('t', '', 'i', 1), (a, c) -> if(c rlike '[0-9]', named_struct('t', concat(a.t, substring(s, a.i, 1)), 'i', a.i + 1), named_struct('t', concat(a.t, c), 'i', a.i)), a -> a.t)"
)
_FILL_ALL = "aggregate(split(o, ''), named_struct('t', '', 'i', 1), (a, c) -> if(c <> ' ', named_struct('t', concat(a.t, substring(s, a.i, 1)), 'i', a.i + 1), named_struct('t', concat(a.t, c), 'i', a.i)), a -> a.t)"


def _capitals(o: str, s: str) -> str:
    """The surrogate s in the case of o."""
    return f"if(length({o}) > 1 and {o} = upper({o}), upper({s}), array_join(transform(split({s}, '-'), w -> concat(upper(substring(w, 1, 1)), substring(w, 2))), '-'))"


_IN_FORM = f"case when kind in ('card', 'ssn', 'phone') then {_FILL} when kind = 'iban' then {_FILL_ALL} when kind in ('ip', 'ipv6') then s when kind = 'email' then if(o = upper(o), upper(s), s) else {_capitals('o', 's')} end"


def replace(docs: DataFrame, ws: Workspace, key: str = KEY) -> DataFrame:
    """All rows and columns of ``docs`` with surrogates in their texts, and ``pii``, the number of mentions by kind (in place of a column of that name)."""
    found = ws.write(mentions(docs), "mentions")
    table = surrogates(found, ws, key)
    named = found.join(table.hint("merge"), ["kind", "canon"]).withColumnsRenamed({"form": "o", "surrogate": "s"})
    named = named.select("id", "version", "place", "part", "kind", "canon", "s", F.expr(_IN_FORM).alias("new"))
    # A document's mentions: as many as its text holds.
    parts = named.groupBy("id", "version").agg(F.sort_array(F.collect_set(F.struct("place", "part", "new", "kind", "canon", "s"))).alias("found"))
    others = [c for c in docs.columns if c not in ("text", "pii")]
    rows = docs.select(F.struct(*(docs[c] for c in others)).alias("row"), F.col("doc_id").alias("own_id"), "text", _version().alias("own"))
    joined = rows.join(parts.hint("merge"), F.col("own_id").eqNullSafe(F.col("id")) & (F.col("own") == F.col("version")), "left")
    joined = joined.withColumn("words", F.expr("map_from_entries(array_distinct(transform(filter(found, n -> n.kind = 'name'), n -> struct(n.canon, n.s))))"))
    quoted, name = _quoted(ENTITY), _quoted(rf"(?<!\p{{L}}){_NAME}")
    # Between the mentions, name words of this document's mentions are replaced too.
    bare = _capitals("y.`1`", "words[lower(y.`1`)]")
    between = f"if(size(words) = 0, z.`0`, array_join(transform(arrays_zip(split(z.`0`, {name}, -1), regexp_extract_all(z.`0`, {name}, 0)), y -> concat(y.`0`, case when y.`1` is null then '' when words[lower(y.`1`)] is null then y.`1` else {bare} end)), ''))"
    rebuilt = (
        f"if(found is null, text, array_join(flatten(transform(arrays_zip(split(text, {quoted}, -1), regexp_extract_all(text, {quoted}, 0)), (z, i) -> array({between},"
        " if(z.`1` is null, '', concat(regexp_extract(z.`1`, " + _quoted(f"^(?:{_TITLE})[.]?[ ]") + ", 0),"
        " array_join(transform(filter(found, n -> n.place = i), n -> n.new), ' ')))))), ''))"
    )
    counts = "map_from_entries(transform(array_sort(array_distinct(transform(found, n -> n.kind))), k -> struct(k, size(array_distinct(transform(filter(found, n -> n.kind = k), n -> n.place))))))"
    return joined.select(*(F.col("row")[c].alias(c) for c in others), F.expr(rebuilt).alias("text"), F.coalesce(F.expr(counts), F.expr("cast(map() as map<string, int>)")).alias("pii"))


def digest(docs: DataFrame, ws: Workspace, key: str = KEY) -> DataFrame:
    """doc_id, the text with surrogates, and the number of mentions of each kind."""
    done = replace(docs.select("doc_id", "text"), ws, key)
    count = lambda *kinds: F.expr(" + ".join(f"coalesce(element_at(pii, '{k}'), 0)" for k in kinds)).cast("long")
    return done.select("doc_id", "text", *(count(k).alias(f"n_{k}") for k in ("email", "card", "ip", "ipv6", "phone", "iban", "ssn", "name")))
