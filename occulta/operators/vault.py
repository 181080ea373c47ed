"""The vault: which value has which token, per mission.

A vault is a table (mission, type, value, number, variant, token, created_at).
Values get their numbers per mission and type in order of first appearance:
document, then place. Numbering sorts by ranges and adds up counts per range,
so no type's values have to fit in one task.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.spans import TOKEN, let, quote, token
from ..sources.tables import materialise

COLUMNS = "mission string, type string, value string, number long, variant string, token string, created_at timestamp"


def numbered(rows: DataFrame, by: list[str], order: list[str], name: str = "number") -> DataFrame:
    """``rows`` with a number from 1 within each ``by``, in ``order``, without gathering a group.

    Rows are sorted by range over all partitions and written; a row's number is
    its place in its partition's run plus the sizes of the runs before it.
    """
    keys = [F.col(c) for c in (*by, *order)]
    ranged = materialise(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("__at", 33)
    runs = ranged.groupBy(*by, part.alias("__part")).agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    from pyspark.sql import Window

    # as many rows as partitions and groups that begin in them
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.withColumn("__before", before).drop("__n")
    return ranged.withColumn("__part", part).join(runs, [*by, "__part"]).withColumn(name, (F.col("__at") - F.col("__first") + F.col("__before") + 1).cast("long")).drop("__at", "__part", "__first", "__before")


def allocate(found: DataFrame, vault: DataFrame | None = None, now: Column | None = None, variants: bool = False) -> DataFrame:
    """Vault rows for the values of ``found(mission, type, value, doc_id, s)`` that ``vault`` lacks.

    A value keeps one token however often it comes; the same value under
    another type has another. Numbers go on from the highest given. With
    ``variants`` names that share a distinctive word, among themselves or with
    the vault's, are one person: they get the person's number, the oldest of
    several, and letters of their own. Tokens given before never change.
    """
    firsts = found.groupBy("mission", "type", "value").agg(F.min(F.struct("doc_id", "s")).alias("first"))
    if vault is not None:
        firsts = firsts.join(vault.select("mission", "type", "value"), ["mission", "type", "value"], "left_anti")
    new = numbered(firsts.select("mission", "type", "value", F.col("first.doc_id").alias("__doc"), F.col("first.s").alias("__s")), ["mission", "type"], ["__doc", "__s", "value"])
    high = None if vault is None else vault.groupBy("mission", "type").agg(F.max("number").alias("__high"))

    def after(rows: DataFrame) -> DataFrame:
        return rows if high is None else rows.join(high, ["mission", "type"], "left").withColumn("number", F.col("number") + F.coalesce("__high", F.lit(0))).drop("__high")

    new = after(new).select("mission", "type", "value", "number", F.lit("").alias("variant"))
    if variants:
        new = materialise(new, "new")
        names = new.filter("type = 'NOM'").select("mission", "value", "number")
        if not names.isEmpty():
            old = None if vault is None else vault.filter("type = 'NOM'").select("mission", "value", "number")
            labels = person_labels(names, old)
            # a person who is new is numbered by the first of the names
            fresh = labels.filter("label = own").select("mission", F.lit("NOM").alias("type"), "label")
            fresh = after(numbered(fresh, ["mission", "type"], ["label"])).select("mission", "label", F.col("number").alias("__new"))
            placed = labels.join(fresh, ["mission", "label"], "left").withColumn("number", F.coalesce("__new", "label"))
            before = F.lit(0).cast("long")
            if old is not None:
                placed = placed.join(old.groupBy("mission", "number").agg(F.count("*").alias("__given")), ["mission", "number"], "left")
                before = F.coalesce("__given", before)
            placed = numbered(placed.withColumn("__seen", before), ["mission", "number"], ["own", "value"], "k").withColumn("k", F.col("k") + F.col("__seen") - 1)
            given = placed.select("mission", F.lit("NOM").alias("type"), "value", "number", F.expr(f"if(k = 0, '', {letters('k')})").alias("variant"))
            new = new.filter("type <> 'NOM'").unionByName(given)
    return new.select("mission", "type", "value", "number", "variant", F.expr(token("type", "number", "variant")).alias("token"), (now if now is not None else F.current_timestamp()).alias("created_at"))


def person_labels(names: DataFrame, old: DataFrame | None = None, rounds: int = 60) -> DataFrame:
    """(mission, value, own, label) of ``names(mission, value, number)``: the least number among names connected by distinctive words.

    ``old`` names have lower numbers, which never change; a name that shares a
    word with them takes the least of theirs, whatever new names connect it to,
    and hands it on to those that share a word with none. Labels spread from
    names to words and back, then to the label of the label's own row, so that
    chains shorten by more than a link a round, until none changes; beyond
    ``rounds`` an error is raised. A word that very many names share is one row
    of labels, not pairs.
    """
    words = materialise(names.select("mission", "value", F.explode(F.expr(distinctive_words())).alias("word")), "words")
    labels, known, fixed = names.select("mission", "value", F.col("number").alias("own"), F.col("number").alias("label")), None, None
    if old is not None:
        of_old = old.select("mission", F.explode(F.expr(distinctive_words())).alias("word"), F.col("number").alias("label")).groupBy("mission", "word").agg(F.min("label").alias("label"))
        known = materialise(words.join(of_old, ["mission", "word"]).groupBy("mission", "value").agg(F.min("label").alias("label")), "known")
        fixed = words.join(known, ["mission", "value"]).select("mission", "word", "label")
        known = labels.drop("label").join(known, ["mission", "value"])
        labels = materialise(labels.join(known.select("mission", "value"), ["mission", "value"], "left_anti"), "labels")
    state = None
    for _ in range(rounds):
        of_word = words.join(labels, ["mission", "value"]).select("mission", "word", "label")
        of_word = (of_word if fixed is None else of_word.unionByName(fixed)).groupBy("mission", "word").agg(F.min("label").alias("w"))
        of_value = words.join(of_word, ["mission", "word"]).groupBy("mission", "value").agg(F.min("w").alias("w"))
        spread = materialise(labels.join(of_value, ["mission", "value"], "left").select("mission", "value", "own", F.least("label", F.coalesce("w", "label")).alias("label")), "spread")
        of_own = spread.groupBy("mission", F.col("own").alias("label")).agg(F.min("label").alias("l"))
        labels = materialise(spread.join(of_own, ["mission", "label"], "left").select("mission", "value", "own", F.least("label", F.coalesce("l", "label")).alias("label")), "labels")
        new = labels.agg(F.sum("label")).first()[0]
        if new == state:
            return labels if known is None else labels.unionByName(known.select(*labels.columns))
        state = new
        if new is None:  # all names are the old ones' own
            return known
    raise RuntimeError(f"no end after {rounds} rounds")


def distinctive_words(value: str = "value", least: int = 4) -> str:
    """SQL: the words of a name that can tell it, in capitals, titles left out."""
    return f"array_distinct(filter(split(upper({value}), r'(?U)[^\\p{{L}}\\p{{N}}]+'), w -> length(w) >= {least} AND NOT w IN ('MADAME', 'MONSIEUR', 'MADEMOISELLE', 'MAITRE', 'MAÎTRE')))"


def letters(k: str) -> str:
    """SQL: a number from 1 as letters: a to z, aa, ab and so on."""
    return f"""aggregate(sequence(1, 14), named_struct('n', cast({k} AS bigint), 'out', ''),
      (a, i) -> if(a.n = 0, a, named_struct('n', (a.n - 1) div 26, 'out', concat(char(97 + (a.n - 1) % 26), a.out))), a -> a.out)"""


def variant_groups(rows: DataFrame, rounds: int = 60) -> DataFrame:
    """A whole vault numbered anew: names of one mission that share a distinctive word, directly or by others, get one number.

    NOM rows come back with the least number of their group and, where a group
    has several members, letters by their own numbers (a to z, aa, ab ...). See
    ``allocate`` for a vault whose tokens are out already.
    """
    names = materialise(rows.filter("type = 'NOM'").select("mission", "value", "number", "variant"), "names")
    labels = person_labels(names.select("mission", "value", "number"), rounds=rounds)
    grouped = names.join(labels.select("mission", "value", "label"), ["mission", "value"]).withColumn("__long", F.length("variant"))
    sizes = grouped.groupBy("mission", "label").agg(F.count("*").alias("n"))
    placed = numbered(grouped, ["mission", "label"], ["number", "__long", "variant", "value"], "k").join(sizes, ["mission", "label"])
    given = placed.select("mission", "value", F.col("label").alias("number"), F.expr(f"if(n = 1, '', {letters('k')})").alias("variant"))
    others = rows.filter("type <> 'NOM'")
    own = rows.filter("type = 'NOM'").drop("number", "variant", "token").join(given, ["mission", "value"]).withColumn("token", F.expr(token("type", "number", "variant")))
    return others.unionByName(own.select(*others.columns))


def tokens_in(text: str = "text") -> str:
    """SQL: the distinct tokens of a text, in order of appearance."""
    return f"array_distinct(regexp_extract_all({text}, r'{TOKEN}', 0))"


def forget(vault: DataFrame, value: str) -> DataFrame:
    """The vault without one value."""
    return vault.filter(F.col("value") != value)


def forget_subject(vault: DataFrame, part: str) -> DataFrame:
    """The vault without the values that contain ``part``, in any case; an empty part forgets nothing."""
    return vault.filter(~subject(part)) if part.strip() else vault


def subject(part: str) -> Column:
    """Whether a value concerns a person."""
    return F.contains(F.lower("value"), F.lit(part.strip().lower()))


def subject_count(vault: DataFrame, part: str) -> DataFrame:
    """How many values forgetting a person would delete."""
    return vault.agg(F.count_if(subject(part) & F.lit(bool(part.strip()))).alias("n_values"))


def rectify(vault: DataFrame, old: str, new: str) -> DataFrame:
    """The vault with one value renamed under its token."""
    return vault.withColumn("value", F.when(F.col("value") == old, F.lit(new)).otherwise(F.col("value")))


def expired(days: int, now: Column | None = None) -> Column:
    """Whether a row is older than ``days``."""
    return F.col("created_at") < (now if now is not None else F.current_timestamp()) - F.expr(f"INTERVAL {int(days)} DAYS")


def purged(vault: DataFrame, days: int, now: Column | None = None) -> DataFrame:
    """The vault without rows older than ``days``."""
    return vault.filter(~expired(days, now))


#: What stands before a sealed value; rounds of key derivation.
SEAL, ROUNDS = "sealed1:", 600_000


def derived(passphrase: str, salt: bytes, rounds: int = ROUNDS) -> bytes:
    """A key of 32 bytes from a passphrase (PBKDF2, SHA-256); the salt is kept beside the vault."""
    return hashlib.pbkdf2_hmac("sha256", passphrase.encode(), salt, rounds)


def _with_key(rows: DataFrame, key: bytes | str) -> DataFrame:
    """``rows`` with ``__k``, the key: joined from a table of one row, so that no plan shows it."""
    one = rows.sparkSession.createDataFrame([(0, key.encode() if isinstance(key, str) else bytes(key))], "__one int, __k binary")
    return rows.withColumn("__one", F.lit(0)).join(F.broadcast(one), "__one").drop("__one")


def sealed(vault: DataFrame, key: bytes | str) -> DataFrame:
    """The vault with values encrypted and authenticated (AES-GCM); ``key``: 16, 24 or 32 bytes. Sealed values stay, so this may be repeated."""
    put = F.concat(F.lit(SEAL), F.base64(F.aes_encrypt(F.encode("value", "utf-8"), F.col("__k"), F.lit("GCM"))))
    return _with_key(vault, key).withColumn("value", F.when(plaintext(vault), put).otherwise(F.col("value"))).select(*vault.columns)


def opened(vault: DataFrame, key: bytes | str) -> DataFrame:
    """The opposite of :func:`sealed`; a wrong key or changed bytes raise an error, and values that aren't sealed stay."""
    read = F.decode(F.aes_decrypt(F.unbase64(F.substring("value", len(SEAL) + 1, 1 << 30)), F.col("__k"), F.lit("GCM")), "utf-8")
    return _with_key(vault, key).withColumn("value", F.when(plaintext(vault), F.col("value")).otherwise(read)).select(*vault.columns)


def plaintext(vault: DataFrame) -> Column:
    """Whether a stored value is not sealed."""
    return ~F.col("value").rlike(f"^{SEAL}[A-Za-z0-9+/\r\n]{{38,}}=*$")


def plaintext_count(vault: DataFrame) -> int:
    """How many values of a stored vault can be read by anyone."""
    return vault.filter(plaintext(vault)).count()


def migrate(spark: SparkSession, path: str, key: bytes | str) -> int:
    """Seal the plain values of a stored vault; returns how many there were. Nothing is written if there is none.

    The new table is written beside the old one, which goes only when the new one is whole.
    """
    old = spark.read.parquet(path)
    n = plaintext_count(old)
    if n:
        new, gone = f"{path}.sealed", f"{path}.plain"
        sealed(old, key).write.mode("overwrite").parquet(new)
        jvm = spark.sparkContext._jvm
        at = [jvm.org.apache.hadoop.fs.Path(p) for p in (path, new, gone)]
        fs = at[0].getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        fs.rename(at[0], at[2])
        fs.rename(at[1], at[0])
        fs.delete(at[2], True)
    return n


#: Forenames of stand-ins; the key that shuffles them where none is given.
_FIRST = "Alix Camille Charlie Claude Dominique Eden Lou Maxime Noa Sacha".split()
KEY, FEISTEL_ROUNDS = "stand-ins", 4


def shuffled(number: str, digits: int, key: str, tweak: str = "''") -> str:
    """SQL: a number's ``digits`` digits, more if it has more, as others by a keyed permutation: different numbers never give the same.

    A Feistel network over decimal halves: to one half the digest of the other
    is added, in turn, each step of which can be undone.
    """
    wide = f"greatest({digits}, length(cast({number} AS string)))"
    low, high = "cast(pow(10, wd div 2) AS bigint)", "cast(pow(10, wd - wd div 2) AS bigint)"
    state = f"named_struct('l', {number} div {low}, 'r', {number} % {low})"
    turn = f"""if(i % 2 = 0, named_struct('l', pmod(a.l + pmod(xxhash64({quote(key)}, {tweak}, wd, i, a.r), {high}), {high}), 'r', a.r),
      named_struct('l', a.l, 'r', pmod(a.r + pmod(xxhash64({quote(key)}, {tweak}, wd, i, a.l), {low}), {low})))"""
    return let("wd", wide, f"aggregate(sequence(1, {2 * FEISTEL_ROUNDS}), {state}, (a, i) -> {turn}, a -> concat(lpad(cast(a.l AS string), wd - wd div 2, '0'), lpad(cast(a.r AS string), wd div 2, '0')))")


def luhn_digit(digits: str) -> str:
    """SQL: the digit that completes ``digits`` so that the check of cards holds."""
    total = f"aggregate(sequence(1, length({digits})), 0, (a, i) -> a + transform(array(cast(substring({digits}, -i, 1) AS int) * if(i % 2 = 1, 2, 1)), d -> if(d > 9, d - 9, d))[0])"
    return f"cast(pmod(-{total}, 10) AS string)"


def surrogate(key: str = KEY, variant: str = "''") -> Column:
    """A stand-in of the same kind as the value, stable by number, distinct within a type at any number, its check digits right.

    Accounts are of a bank that there is none of, phone numbers of a range kept
    for fiction while six digits do, addresses of a domain that never resolves.
    ``variant``: SQL of a variant's letters, which follow the stand-in.
    """

    def digits(n: int) -> str:
        return shuffled("number", n, key, "type")

    # two digits are a syllable, so that names tell numbers apart
    even = f"if(length(d) % 2 = 0, d, concat('0', d))"
    syllables = "array_join(transform(regexp_extract_all(e, '..', 0), x -> concat(substring('bcdfgjklmnprstvxzhqw', cast(x AS int) div 5 + 1, 1), substring('aeiou', cast(x AS int) % 5 + 1, 1))), '')"
    name = let("d", digits(8), let("e", even, f"concat(element_at(array({', '.join(map(quote, _FIRST))}), cast(pmod(xxhash64({quote(key)}, number), {len(_FIRST)}) AS int) + 1), ' ', initcap({syllables}))"))
    bank = "concat('99999', '00000', d, lpad(cast(97 - cast((cast(89 AS decimal(38,0)) * 99999 + 3 * cast(d AS decimal(38,0))) % 97 AS int) AS string), 2, '0'))"
    iban = let("d", digits(11), let("b", bank, "concat('FR', lpad(cast(98 - cast(cast(concat(b, '152700') AS decimal(38,0)) % 97 AS int) AS string), 2, '0'), b)"))
    secu = let("d", digits(10), let("n", "concat('1', substring(d, 1, 2), '20', substring(d, 3))", "concat(n, lpad(cast(97 - cast(cast(n AS decimal(38,0)) % 97 AS int) AS string), 2, '0'))"))
    tel = let("d", digits(6), "concat('01 99 ', array_join(regexp_extract_all(d, '..?', 0), ' '))")
    made = f"""CASE type WHEN 'NOM' THEN {name} WHEN 'EMAIL' THEN concat('contact', number, '@exemple.invalid') WHEN 'IBAN' THEN {iban} WHEN 'SECU' THEN {secu} WHEN 'TEL' THEN {tel}
      WHEN 'SIREN' THEN {let('d', digits(8), f"concat(d, {luhn_digit('d')})")} WHEN 'SIRET' THEN {let('d', digits(13), f"concat(d, {luhn_digit('d')})")}
      WHEN 'ISIN' THEN {let('d', digits(9), f"concat('FR', d, {luhn_digit("concat('1527', d)")})")} ELSE concat(type, '-', number) END"""
    return F.expr(f"concat({made}, if({variant} = '', '', concat('-', {variant})))")


#: Digits that a type's stand-in is made of, more if its number has more; those that end in a Luhn digit.
DIGITS = {"NOM": 8, "IBAN": 11, "SECU": 10, "TEL": 6, "SIREN": 8, "SIRET": 13, "ISIN": 9}
_LUHN = ("SIREN", "SIRET", "ISIN")
#: Digits beyond which check digits are made by a slower expression; the syllable of each pair of digits.
_USUAL = 14
_SYLLABLES = [c + v for c in "bcdfgjklmnprstvxzhqw" for v in "aeiou"]


def _shuffle(key: str) -> list[tuple[str, str]]:
    """Names and SQL, each of those before: the digits ``__d`` that a number becomes by a keyed permutation, so that different numbers never give the same.

    The rounds of :func:`shuffled` without lambdas, so that Spark compiles them where they are columns.
    """
    wide = " ".join(f"WHEN '{t}' THEN greatest({n}, length(cast(number AS string)))" for t, n in DIGITS.items())
    steps = [("__wd", f"CASE type {wide} END"), ("__low", "cast(pow(10, __wd div 2) AS bigint)"), ("__high", "cast(pow(10, __wd - __wd div 2) AS bigint)")]

    def turn(i: int | str, half: str, other: str, size: str) -> str:
        return f"pmod({half} + pmod(xxhash64({quote(key)}, type, __wd, {i}, {other}), {size}), {size})"

    left, right = "number div __low", "number % __low"
    steps += [("__l0", left), ("__r0", right)]
    left, right = "__l0", "__r0"
    for i in range(1, 2 * FEISTEL_ROUNDS + 1):
        if i % 2 == 0:
            steps.append((f"__l{i}", turn(i, left, right, "__high")))
            left = f"__l{i}"
        else:
            steps.append((f"__r{i}", turn(i, right, left, "__low")))
            right = f"__r{i}"
    digits = f"concat(lpad(cast({left} AS string), __wd - __wd div 2, '0'), lpad(cast({right} AS string), __wd div 2, '0'))"
    return [*steps, ("__d", digits), ("__check", _check(left, right))]


def _check(left: str, right: str) -> str:
    """SQL: what a type's check digits are made of: the Luhn sum of all digits, an ISIN's country included, or the rest of the digits by 97.

    Up to ``_USUAL`` digits are added one by one; the lambda for wider ones also
    keeps Spark from fusing this with the rounds into a method too long for the JVM to compile.
    """

    def total(half: str, doubled: int) -> str:
        each = [(i, f"({half} div {10**i} % 10)") for i in range(_USUAL // 2)]
        return " + ".join(f"{d} * 2 - if({d} > 4, 9, 0)" if i % 2 == doubled else d for i, d in each)

    usual = f"{total(right, 0)} + if(__wd div 2 % 2 = 0, {total(left, 0)}, {total(left, 1)})"
    wider = f"aggregate(sequence(1, __wd), 0L, (a, i) -> a + {let('x', 'cast(substring(__d, -i, 1) AS int) * if(i % 2 = 1, 2, 1)', 'if(x > 9, x - 9, x)')})"
    luhn = f"if(__wd <= {_USUAL}, {usual}, {wider}) + CASE WHEN type <> 'ISIN' THEN 0 WHEN __wd % 2 = 0 THEN 9 ELSE 18 END"
    return f"CASE WHEN type IN {_LUHN} THEN {luhn} WHEN type = 'IBAN' THEN ({left} % 97 * __low + {right}) % 97 END"


def _stand_in(key: str, variant: str) -> str:
    """SQL of a stand-in by the columns of :func:`_shuffle`."""

    def syllable(pair: str, first: bool) -> str:
        given = ", ".join(map(quote, map(str.capitalize, _SYLLABLES) if first else _SYLLABLES))
        return f"element_at(array({given}), cast({pair} AS int) + 1)"

    # two digits are a syllable, so that names tell numbers apart
    even = "if(length(__d) % 2 = 0, __d, concat('0', __d))"
    usual = ", ".join(syllable(f"substring(__d, {2 * i + 1}, 2)", i == 0) for i in range(DIGITS["NOM"] // 2))
    wider = f"array_join(transform(regexp_extract_all({even}, '..', 0), (x, i) -> if(i = 0, {syllable('x', True)}, {syllable('x', False)})), '')"
    name = f"concat(element_at(array({', '.join(map(quote, _FIRST))}), cast(pmod(xxhash64({quote(key)}, number), {len(_FIRST)}) AS int) + 1), ' ', if(__wd = {DIGITS['NOM']}, concat({usual}), {wider}))"
    tel = f"concat('01 99 ', if(__wd = {DIGITS['TEL']}, concat(substring(__d, 1, 2), ' ', substring(__d, 3, 2), ' ', substring(__d, 5, 2)), array_join(regexp_extract_all(__d, '..?', 0), ' ')))"
    # the bank's key, then the account's check digits: of 99999 00000, the digits and the key, by 97
    bank = f"(97 - ({89 * 99999} + 3 * __check) % 97)"
    whole = f"(({9999900000 % 97} * (__low % 97) * (__high % 97) + __check) * 100 + {bank}) % 97"
    iban = f"concat('FR', lpad(cast(98 - ({whole} * 1000000 + 152700) % 97 AS string), 2, '0'), '9999900000', __d, lpad(cast({bank} AS string), 2, '0'))"
    number = "concat('1', substring(__d, 1, 2), '20', substring(__d, 3))"
    secu = f"concat({number}, lpad(cast(97 - if(__wd <= 15, cast({number} AS bigint) % 97, cast(cast({number} AS decimal(38,0)) % 97 AS bigint)) AS string), 2, '0'))"
    made = f"""CASE WHEN number IS NULL THEN NULL WHEN type = 'NOM' THEN {name} WHEN type = 'EMAIL' THEN concat('contact', number, '@exemple.invalid') WHEN type = 'IBAN' THEN {iban} WHEN type = 'SECU' THEN {secu} WHEN type = 'TEL' THEN {tel}
      WHEN type IN ('SIREN', 'SIRET') THEN concat(__d, pmod(-__check, 10)) WHEN type = 'ISIN' THEN concat('FR', __d, pmod(-__check, 10)) ELSE concat(type, '-', number) END"""
    return f"concat({made}, if({variant} = '', '', concat('-', {variant})))"


def with_surrogates(rows: DataFrame, name: str, key: str = KEY, variant: str = "''") -> DataFrame:
    """``rows(type, number, ...)`` with :func:`surrogate` as ``name``, its steps columns on the way, which Spark compiles."""
    steps = _shuffle(key)
    for step, sql in steps:
        rows = rows.withColumn(step, F.expr(sql))
    return rows.withColumn(name, F.expr(_stand_in(key, variant))).drop(*(step for step, _ in steps))


def masked_value(value: str = "value") -> str:
    """SQL: a value for display, two characters of each word and up to six dots."""
    return f"array_join(transform(split({value}, ' '), w -> concat(substring(w, 1, 2), repeat('•', least(6, greatest(0, length(w) - 2))))), ' ')"


def value_hash(value: str = "value") -> str:
    """SQL: the digest by which a value is found without being stored."""
    return f"sha2(lower(trim({value})), 256)"


def row_id(value: str, key: bytes | str) -> str:
    """SQL: an opaque id of a listed value: HMAC-SHA256 of it, in lower case and trimmed, by the key, 24 hex digits.

    The key's two pads are written as bytes; whoever sees the plan can compute ids, so the key is one of the process, not a stored one.
    """
    raw = key.encode() if isinstance(key, str) else bytes(key)
    raw = (hashlib.sha256(raw).digest() if len(raw) > 64 else raw).ljust(64, b"\0")
    inner, outer = (bytes(b ^ pad for b in raw).hex() for pad in (0x36, 0x5C))
    return f"substring(sha2(concat(X'{outer}', unhex(sha2(concat(X'{inner}', cast(lower(trim({value})) AS binary)), 256))), 256), 1, 24)"


def by_row_id(rows: DataFrame, ids: DataFrame, key: bytes | str) -> DataFrame:
    """Those of ``rows(value, ...)`` that ``ids(row_id)`` name."""
    return rows.withColumn("row_id", F.expr(row_id("value", key))).join(ids.select("row_id").distinct(), "row_id", "left_semi")


def missions(vault: DataFrame) -> DataFrame:
    """(mission, n_values, created_at) of each mission, by its first value's time."""
    return vault.groupBy("mission").agg(F.count("*").alias("n_values"), F.min("created_at").alias("created_at"))


def revealed(vault: DataFrame, mission: str, token_: str) -> tuple[DataFrame, DataFrame]:
    """(the value of one token, the audit row that says it was shown, without the value)."""
    row = vault.filter((F.col("mission") == mission) & (F.col("token") == token_)).select("value", "type")
    empty = F.create_map().cast("map<string,string>")
    log = row.select(F.current_timestamp().cast("string").alias("timestamp"), F.lit(mission).alias("mission"), F.lit("vault_reveal").alias("event"), empty.alias("counts"), F.lit(1).alias("total"))
    return row, log
