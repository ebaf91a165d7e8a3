"""Schema contracts and matching of profiles against them.

Both sides are frames with one row per column, so one job matches thousands of
files: the contract's columns travel as one array per contract, each incoming
column scores them in place, and a file's columns are then folded in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import textfn
from ..functions.similarity import edit_score, normal_name
from ..functions.sketches import overlap

# groups of column names that mean the same (fixed values)
SYNONYMS = {
    "email": ["email", "e_mail", "email_address", "emailaddress", "e-mail", "mail"],
    "phone": ["phone", "telephone", "tel", "phone_number", "phonenumber", "mobile", "cell"],
    "name": ["name", "full_name", "fullname", "customer_name", "customername", "user_name", "username"],
    "first_name": ["first_name", "firstname", "fname", "first", "given_name", "givenname"],
    "last_name": ["last_name", "lastname", "lname", "last", "surname", "family_name", "familyname"],
    "address": ["address", "street_address", "streetaddress", "addr", "street"],
    "city": ["city", "town", "municipality"],
    "state": ["state", "province", "region", "state_province"],
    "country": ["country", "nation", "country_code", "countrycode"],
    "zip": ["zip", "zipcode", "zip_code", "postal_code", "postalcode", "postal"],
    "date": ["date", "dt", "created_date", "createddate", "updated_date", "updateddate"],
    "id": ["id", "identifier", "key", "pk", "primary_key"],
    "customer_id": ["customer_id", "customerid", "cust_id", "custid", "client_id", "clientid"],
    "order_id": ["order_id", "orderid", "order_number", "ordernumber"],
    "product_id": ["product_id", "productid", "prod_id", "prodid", "item_id", "itemid"],
    "amount": ["amount", "total", "total_amount", "totalamount", "sum", "value"],
    "price": ["price", "unit_price", "unitprice", "cost", "rate"],
    "quantity": ["quantity", "qty", "count", "num", "number"],
    "status": ["status", "state", "condition", "status_code", "statuscode"],
    "description": ["description", "desc", "details", "notes", "comment", "comments"],
}

# semantic types that may stand for each other (fixed values)
TYPE_GROUPS = {
    "identifiers": ["id", "numeric"],
    "contact": ["email", "phone", "url"],
    "temporal": ["date", "datetime", "time"],
    "numeric": ["numeric", "currency", "percentage"],
    "text": ["text", "name", "category", "unknown"],
    "location": ["zipcode", "country", "state"],
}

# column types a column type may be read as (fixed values)
DTYPE_OK = {
    "int64": ["int64", "int32", "float64", "object"],
    "int32": ["int64", "int32", "float64", "object"],
    "float64": ["int64", "int32", "float64", "object"],
    "object": ["object", "string", "category"],
    "bool": ["bool", "object"],
    "datetime64[ns]": ["datetime64[ns]", "object"],
    "category": ["category", "object"],
}

HIGH, MEDIUM, LOW = 85, 60, 40


def _plain(name: str) -> str:
    for ch in " _-.":
        name = name.lower().replace(ch, "")
    return name


def _synonym_groups() -> dict[str, str]:
    """Normalised name -> its first group."""
    out: dict[str, str] = {}
    for group, names in SYNONYMS.items():
        for n in names:
            out.setdefault(_plain(n), group)
    return out


def _lookup(table: dict) -> Column:
    def lit(v):
        return F.array(*[F.lit(x) for x in v]) if isinstance(v, list) else F.lit(v)

    return F.create_map(*[c for k, v in table.items() for c in (F.lit(k), lit(v))])


def synonym_group(name: Column) -> Column:
    return F.try_element_at(_lookup(_synonym_groups()), normal_name(name))


def types_compatible(a: Column, b: Column) -> Column:
    groups: dict[str, list[str]] = {}
    for g, kinds in TYPE_GROUPS.items():
        for k in kinds:
            groups.setdefault(k, []).append(g)
    of = lambda c: F.coalesce(F.try_element_at(_lookup(groups), c), F.array().cast("array<string>"))
    return (a == b) | (a == "unknown") | (b == "unknown") | F.arrays_overlap(of(a), of(b))


def type_score(a: Column, b: Column) -> Column:
    """1 equal, 0.5 unknown, 0.7 same group, 0.2 else."""
    return F.when(a == b, 1.0).when((a == "unknown") | (b == "unknown"), 0.5).when(types_compatible(a, b), 0.7).otherwise(0.2)


def dtype_ok(a: Column, b: Column) -> Column:
    x, y = F.lower(F.trim(a)), F.lower(F.trim(b))
    return (x == y) | F.coalesce(F.array_contains(F.try_element_at(_lookup(DTYPE_OK), x), y), F.lit(False))


def value_overlap(a: Column, b: Column) -> Column:
    """Share of the values of either column that both have, from the sketches of their values (``functions.sketches``)."""
    return overlap(a, b)


def name_match(incoming: Column, target: Column, alternatives: Column) -> Column:
    """(score, match_type): exact 1, normalised or alternative 0.95, synonym 0.85, fuzzy x0.9 from 0.7, else weak x0.5."""
    pair = lambda s, t: F.struct((s if isinstance(s, Column) else F.lit(s)).cast("double").alias("score"), F.lit(t).alias("match_type"))
    n = normal_name(incoming)
    alt = F.exists(alternatives, lambda a: normal_name(a) == n)
    sim = edit_score(incoming, target)
    return (F.when(incoming == target, pair(1.0, "exact")).when(n == normal_name(target), pair(0.95, "normalized"))
            .when(F.coalesce(alt, F.lit(False)), pair(0.95, "alternative"))
            .when(F.coalesce(synonym_group(incoming) == synonym_group(target), F.lit(False)), pair(0.85, "synonym"))
            .when(sim >= 0.7, pair(sim * 0.9, "fuzzy")).otherwise(pair(sim * 0.5, "weak")))


def alternative_names(name: Column) -> Column:
    """Spellings of a name and all names of its synonym groups, without the name itself."""
    spelled = F.array(F.lower(name), F.upper(name), textfn.title(name), F.replace(name, F.lit("_"), F.lit(" ")),
                      F.replace(name, F.lit(" "), F.lit("_")), F.replace(name, F.lit("-"), F.lit("_")), F.replace(name, F.lit("_"), F.lit("-")))
    every: dict[str, list[str]] = {}
    for names in SYNONYMS.values():
        for n in names:
            got = every.setdefault(_plain(n), [])
            got += [x for x in names if x not in got]
    same = F.coalesce(F.try_element_at(_lookup(every), normal_name(name)), F.array().cast("array<string>"))
    return F.sort_array(F.array_remove(F.array_union(F.array_distinct(spelled), same), name))


def generate_contract(profile: DataFrame, contract_id: str = "contract", mark_all_required: bool = True) -> DataFrame:
    """One row per expected column of a profiled table."""
    rows = profile.select(
        F.lit(contract_id).alias("contract_id"), "position", F.col("column").alias("name"), alternative_names(F.col("column")).alias("alternative_names"),
        "semantic_type", "dtype", F.col("detected_pattern").alias("expected_pattern"), F.lit(mark_all_required).alias("required"),
        (F.col("null_percent") > 0).alias("nullable"), F.greatest(F.col("null_percent") + 10, F.lit(10.0)).alias("max_null_percent"),
        "sample_values", "values_sketch", F.when(F.col("is_categorical"), F.transform("top_values", lambda v: v["value"])).alias("allowed_values"), "min_value", "max_value")
    return rows


def fingerprint(contract: DataFrame) -> DataFrame:
    """(contract_id, fingerprint): the first 16 hex digits of SHA-256 over name:semantic:dtype in column order."""
    item = F.struct("position", F.concat_ws(":", "name", "semantic_type", "dtype").alias("t"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(item)), lambda x: x["t"]), "|")  # one entry per column
    return contract.groupBy("contract_id").agg(F.substring(F.sha2(joined, 256), 1, 16).alias("fingerprint"))


CANDIDATE = "array<struct<score:double,place:int,target:string,match_type:string,type_ok:boolean,dtype_ok:boolean>>"


def _pair(t: Column, values: bool) -> dict[str, Column]:
    """The parts of the score of an incoming column against the contract column ``t``."""
    m = name_match(F.col("column"), t["name"], t["alternative_names"])
    w_name, w_type, w_value = (0.5, 0.3, 0.2) if values else (0.6, 0.4, 0.0)
    kind = type_score(F.col("semantic_type"), t["semantic_type"])
    overlap = value_overlap(F.col("values_sketch"), t["values_sketch"]) if values else F.lit(0.0)
    return {"target": t["name"], "name_score": m["score"], "match_type": m["match_type"], "type_score": kind, "value_overlap": overlap,
            "score": m["score"] * w_name + kind * w_type + overlap * w_value,
            "type_ok": types_compatible(F.col("semantic_type"), t["semantic_type"]), "dtype_ok": dtype_ok(F.col("dtype"), t["dtype"])}


def _with_targets(incoming: DataFrame, contract: DataFrame) -> DataFrame:
    """Each incoming column beside all columns of its contract, as an array ``targets``."""
    fields = ["position", "name", "alternative_names", "semantic_type", "dtype", "values_sketch", "required"]
    wide = contract.groupBy("contract_id").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("targets"))  # one entry per column
    return incoming.join(wide, "contract_id")


def column_scores(incoming: DataFrame, contract: DataFrame, values: bool = True) -> DataFrame:
    """One row per (file, contract, incoming column, contract column): the parts of their score."""
    pairs = _with_targets(incoming, contract).withColumn("t", F.explode("targets"))
    return pairs.select("file", "contract_id", F.col("column").alias("incoming"), *[c.alias(n) for n, c in _pair(F.col("t"), values).items()])


def _candidates(incoming: DataFrame, contract: DataFrame, values: bool) -> DataFrame:
    """Each incoming column with the contract columns it may become, best first."""
    floor = 0.4 if values else 0.5

    def scored(t: Column) -> Column:
        p = _pair(t, values)
        return F.struct(p["score"].alias("score"), (-t["position"]).alias("place"), *[p[c].alias(c) for c in ("target", "match_type", "type_ok", "dtype_ok")])

    best_first = F.sort_array(F.filter(F.transform("targets", scored), lambda c: c["score"] > floor), asc=False)
    return _with_targets(incoming, contract).withColumn("candidates", best_first.cast(CANDIDATE))


def map_columns(incoming: DataFrame, contract: DataFrame, values: bool = True) -> DataFrame:
    """Greedy mapping in column order: each incoming column takes the best contract column still free.

    ``incoming`` has (file, contract_id, position, column, semantic_type, dtype, values_sketch).
    Result: one row per (file, contract_id) with the arrays ``mappings``, ``unmapped`` and ``targets``.
    """
    cand = _candidates(incoming, contract, values)
    cols = F.sort_array(F.collect_list(F.struct("position", F.col("column").alias("name"), "candidates")))  # one entry per column
    wide = cand.groupBy("file", "contract_id").agg(cols.alias("cols"), F.first("targets").alias("targets"))
    kind = "array<struct<incoming:string,target:string,score:double,match_type:string,type_ok:boolean,dtype_ok:boolean>>"

    def take(acc: Column, c: Column) -> Column:
        free = F.filter(c["candidates"], lambda x: ~F.exists(acc, lambda m: m["target"] == x["target"]))
        best = F.get(free, F.lit(0))
        one = F.array(F.struct(c["name"].alias("incoming"), best["target"].alias("target"), best["score"].alias("score"),
                               best["match_type"].alias("match_type"), best["type_ok"].alias("type_ok"), best["dtype_ok"].alias("dtype_ok")))
        return F.when(best.isNull(), acc).otherwise(F.concat(acc, one)).cast(kind)

    done = wide.withColumn("mappings", F.aggregate("cols", F.array().cast(kind), take))
    names = F.transform("cols", lambda c: c["name"])
    return done.withColumn("unmapped", F.array_except(names, F.transform("mappings", lambda m: m["incoming"]))).drop("cols")


def match_schema(incoming: DataFrame, contract: DataFrame) -> DataFrame:
    """One row per (file, contract): mappings, unmapped columns, missing required ones, score, level, flags."""
    m = map_columns(incoming, contract, True)
    taken = F.transform("mappings", lambda x: x["target"])
    required = F.transform(F.filter("targets", lambda t: t["required"]), lambda t: t["name"])
    optional = F.transform(F.filter("targets", lambda t: ~t["required"]), lambda t: t["name"])
    m = m.withColumn("missing_required", F.array_except(required, taken)).withColumn("missing_optional", F.array_except(optional, taken))
    n_req, n_map, n_miss = F.size(required), F.size("mappings"), F.size("missing_required")
    mean = F.coalesce(F.try_divide(F.aggregate("mappings", F.lit(0.0), lambda a, x: a + x["score"]), n_map), F.lit(0.0))
    base = F.try_divide(n_req - n_miss, n_req) * 60 + mean * 40 - n_miss * 15
    score = F.when(F.size("targets") == 0, 0.0).when(n_req == 0, F.when(n_map == 0, 50.0).otherwise(mean * 100)).otherwise(
        F.least(F.lit(100.0), F.greatest(F.lit(0.0), base)))
    m = m.withColumn("score", score)
    level = F.when(F.col("score") >= HIGH, "HIGH").when(F.col("score") >= MEDIUM, "MEDIUM").when(F.col("score") >= LOW, "LOW").otherwise("NO_MATCH")
    return m.select("file", "contract_id", "mappings", "unmapped", "missing_required", "missing_optional", "score", level.alias("level"),
                    (F.col("score") >= LOW).alias("is_compatible"), (F.col("score") >= HIGH).alias("auto_processable"))


def discrepancies(match: DataFrame) -> DataFrame:
    """(file, contract_id, kind, severity, column) rows of a match."""
    def rows(source: str, kind: str, severity: str) -> Column:
        return F.transform(source, lambda c: F.struct(F.lit(kind).alias("kind"), F.lit(severity).alias("severity"), c.alias("column")))

    wrong = F.transform(F.filter("mappings", lambda m: ~m["type_ok"]), lambda m: F.struct(
        F.lit("type_mismatch").alias("kind"), F.lit("warning").alias("severity"), m["incoming"].alias("column")))
    every = F.concat(wrong, rows("missing_required", "missing_required", "critical"), rows("missing_optional", "missing_optional", "info"),
                     rows("unmapped", "extra_column", "info"))
    return match.select("file", "contract_id", F.inline(every))


def match_contracts(source: DataFrame, target: DataFrame) -> DataFrame:
    """Can a source contract feed a target contract? One row per pair of ids: mappings, missing, score, is_chainable.

    ``source`` rows name the target to test in ``target_id``.
    """
    incoming = source.select(F.col("contract_id").alias("file"), F.col("target_id").alias("contract_id"), "position",
                             F.col("name").alias("column"), "semantic_type", "dtype", "values_sketch")
    m = map_columns(incoming, target, False)
    required = F.transform(F.filter("targets", lambda t: t["required"]), lambda t: t["name"])
    missing = F.array_except(required, F.transform("mappings", lambda x: x["target"]))
    m = m.withColumn("missing_required", missing)
    n = F.size(required)
    score = F.when(n > 0, (n - F.size("missing_required")) * 100.0 / n).when(F.size("mappings") > 0, 100.0).otherwise(50.0)
    return m.select(F.col("file").alias("source_id"), F.col("contract_id").alias("target_id"), "mappings", "missing_required",
                    score.alias("score"), ((score >= 80) & (F.size("missing_required") == 0)).alias("is_chainable"))
