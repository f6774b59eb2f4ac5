"""The driver tables as one source of facts, and the queries on them with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import notation
from tessera.model import Attribute, Concept, Premise, Rule, Var
from tessera.plans.compile import Session
from tessera.sources.facts import Many, NarrowFacts, elect, overlaid, select, union, without
from tessera.sources.wide import simple

KEYS = {
    "region": ("r_regionkey", "r_", {}),
    "nation": ("n_nationkey", "n_", {"regionkey": "region:"}),
    "customer": ("c_custkey", "c_", {"nationkey": "nation:"}),
    "supplier": ("s_suppkey", "s_", {"nationkey": "nation:"}),
    "part": ("p_partkey", "p_", {}),
    "orders": ("o_orderkey", "o_", {"custkey": "customer:"}),
    "lineitem": (None, "l_", {"orderkey": "orders:", "partkey": "part:", "suppkey": "supplier:"}),
    "events": ("event_id", "", {}),
    "documents": ("doc_id", "", {}),
    "labels": ("doc_id", "", {}),
}


def source(spark: SparkSession, sf_dir: str, *names: str) -> Many:
    parts = []
    for n in names or KEYS:
        key, strip, entities = KEYS[n]
        df = spark.read.parquet(f"{sf_dir}/{n}.parquet")
        t = simple(df, n, key, strip, entities)
        if n == "labels":  # labels speak of documents
            t.prefix = "documents:"
        parts.append(t)
    return Many(parts)


def C(**fields: str | Attribute) -> Concept:
    """A concept of 'domain/name:Type' fields; a trailing ? makes one optional."""
    out = {}
    for n, x in fields.items():
        if isinstance(x, str):
            the, _, kind = x.partition(":")
            optional = kind.endswith("?")
            x = Attribute(the, kind.rstrip("?") or "Any", optional=optional)
        out[n] = x
    return Concept.of("", **out)


P = Premise.of


def narrow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of regions, nations and customers in the narrow layout."""
    parts = source(spark, sf_dir, "region", "nation", "customer").parts
    return reduce(DataFrame.unionByName, (p.facts() for p in parts))  # tables of their own: no fact is in two


REVENUE = {
    "deduce": {"with": {"revenue": {"the": "nation/revenue", "as": "Float"}}},
    "when": [
        {"assert": {"with": {"cust": {"the": "orders/custkey", "as": "Entity"}, "total": {"the": "orders/totalprice", "as": "Float"}}}, "where": {"this": {"?": {"name": "o"}}, "cust": {"?": {"name": "c"}}, "total": {"?": {"name": "t"}}}},
        {"assert": {"with": {"nation": {"the": "customer/nationkey", "as": "Entity"}}}, "where": {"this": {"?": {"name": "c"}}, "nation": {"?": {"name": "this"}}}},
    ],
    "reduce": {"revenue": {"apply": "sum", "of": {"?": {"name": "t"}}}},
}

CUSTOMER = C(name="customer/name:Text", balance="customer/acctbal:Float", segment="customer/mktsegment:Text", nation="customer/nationkey:Entity")
ORDER = C(customer="orders/custkey:Entity", status="orders/orderstatus:Text", total="orders/totalprice:Float", priority="orders/orderpriority:Text")
LINE = C(order="lineitem/orderkey:Entity", part="lineitem/partkey:Entity", supplier="lineitem/suppkey:Entity", quantity="lineitem/quantity:Float", price="lineitem/extendedprice:Float", discount="lineitem/discount:Float", flag="lineitem/returnflag:Text", status="lineitem/linestatus:Text")
NATION = C(name="nation/name:Text", region="nation/regionkey:Entity")
REGION = C(name="region/name:Text")
SUPPLIER = C(name="supplier/name:Text", nation="supplier/nationkey:Entity", balance="supplier/acctbal:Float")
PART = C(name="part/name:Text", brand="part/brand:Text", type="part/type:Text", size="part/size:SignedInteger", price="part/retailprice:Float")
DOCUMENT = C(lang="documents/lang:Text", source="documents/source:Text", chars="documents/n-chars:SignedInteger")
LABEL = C(quality="labels/quality:SignedInteger", toxic="labels/toxic:SignedInteger")
LABELLED = C(lang="documents/lang:Text", toxic="labels/toxic:SignedInteger?")
EVENT = C(user="events/user-id:SignedInteger", type="events/event-type:Text", value="events/value:Float")

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


def session(spark: SparkSession, sf_dir: str, *names: str, rules: tuple[Rule, ...] = ()) -> Session:
    return Session(spark, source(spark, sf_dir, *names), list(rules))


def rounded(df: DataFrame, *names: str, digits: int = 2) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


# --- folds and joins


@query("SELECT 'nation:' || c_nationkey AS this, round(sum(o_totalprice), 2) AS revenue FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def nation_revenue(spark, sf):
    r = notation.rule(REVENUE)
    return rounded(session(spark, sf, "orders", "customer", rules=(r,)).query(r.deduce), "revenue")


@query("SELECT l_returnflag AS flag, l_linestatus AS status, round(sum(l_quantity), 2) AS quantity, round(sum(l_extendedprice), 2) AS price, round(avg(l_discount), 6) AS discount, count(*) AS n FROM lineitem GROUP BY 1, 2")
def pricing_summary(spark, sf):
    head = C(flag="sum/flag:Text", status="sum/status:Text", quantity="sum/quantity:Float", price="sum/price:Float", discount="sum/discount:Float", n="sum/n:UnsignedInteger")
    r = Rule(head, (P(LINE, quantity="?q", price="?p", discount="?d", flag="?flag", status="?status"),), reduce=folds(quantity=("sum", "q"), price=("sum", "p"), discount=("avg", "d"), n=("count", "q")))
    out = session(spark, sf, "lineitem", rules=(r,)).query(head).drop("this")
    return rounded(rounded(out, "quantity", "price"), "discount", digits=6)


def folds(**f: tuple[str, str]):
    from tessera.model import Fold

    return tuple((n, Fold(apply, Var(of))) for n, (apply, of) in f.items())


@query("SELECT 'customer:' || c_custkey AS this, c_name AS name, c_acctbal AS balance, c_mktsegment AS segment, 'nation:' || c_nationkey AS nation FROM customer")
def concept_scan(spark, sf):
    return session(spark, sf, "customer").query(CUSTOMER)


@query("SELECT 'customer:' || c_custkey AS c, c_name AS name FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 5000")
def filtered_scan(spark, sf):
    return session(spark, sf, "customer").rows([P(CUSTOMER, this="?c", name="?name", balance="?b", segment="BUILDING"), P(">", of="?b", with_=5000)], select=["c", "name"])


@query("SELECT o_orderpriority AS priority, r_name AS region, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2")
def four_way_join(spark, sf):
    head = C(priority="q/priority:Text", region="q/region:Text", n="q/n:UnsignedInteger")
    when = (P(ORDER, this="?o", customer="?c", priority="?priority"), P(CUSTOMER, this="?c", nation="?n1"), P(NATION, this="?n1", region="?r"), P(REGION, this="?r", name="?region"))
    r = Rule(head, when, reduce=folds(n=("count", "o")))
    return session(spark, sf, "orders", "customer", "nation", "region", rules=(r,)).query(head).drop("this")


@query("SELECT n_name AS nation, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1")
def formula_revenue(spark, sf):
    head = C(nation="q/nation:Text", revenue="q/revenue:Float")
    when = (
        P(LINE, supplier="?s", price="?p", discount="?d"),
        P("math/difference", of=1, subtract="?d", is_="?k"),
        P("math/product", of="?p", times="?k", is_="?v"),
        P(SUPPLIER, this="?s", nation="?n"),
        P(NATION, this="?n", name="?nation"),
    )
    r = Rule(head, when, reduce=folds(revenue=("sum", "v")))
    return rounded(session(spark, sf, "lineitem", "supplier", "nation", rules=(r,)).query(head).drop("this"), "revenue")


@query("SELECT l_returnflag AS flag, min(l_quantity) AS lo, max(l_quantity) AS hi, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY 1")
def fold_min_max_distinct(spark, sf):
    head = C(flag="q/flag:Text", lo="q/lo:Float", hi="q/hi:Float", suppliers="q/suppliers:UnsignedInteger")
    r = Rule(head, (P(LINE, flag="?flag", quantity="?q", supplier="?s"),), reduce=folds(lo=("min", "q"), hi=("max", "q"), suppliers=("count-distinct", "s")))
    return session(spark, sf, "lineitem", rules=(r,)).query(head).drop("this")


@query("SELECT count(*) AS n, round(avg(p_retailprice), 4) AS price FROM part WHERE p_size > 40 HAVING count(*) > 0")
def fold_global(spark, sf):
    head = C(n="q/n:UnsignedInteger", price="q/price:Float")
    r = Rule(head, (P(PART, this="?p", size="?s", price="?v"), P(">", of="?s", with_=40)), reduce=folds(n=("count", "p"), price=("avg", "v")))
    return rounded(session(spark, sf, "part", rules=(r,)).query(head).drop("this"), "price", digits=4)


@query("SELECT count(*) AS n FROM part WHERE p_size > 4000 HAVING count(*) > 0")
def fold_global_empty(spark, sf):
    head = C(n="q/n:UnsignedInteger")
    r = Rule(head, (P(PART, this="?p", size="?s"), P(">", of="?s", with_=4000)), reduce=folds(n=("count", "p")))
    return session(spark, sf, "part", rules=(r,)).query(head).drop("this")


@query("SELECT 'documents:' || d.doc_id AS this, d.lang AS lang, CAST(l.toxic AS BIGINT) AS toxic FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def optional_field(spark, sf):
    return session(spark, sf, "documents", "labels").query(LABELLED).withColumn("toxic", F.col("toxic").cast("long"))


@query("SELECT d.lang AS lang, count(l.toxic) AS n FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY 1")
def fold_skips_absent(spark, sf):
    head = C(lang="q/lang:Text", n="q/n:UnsignedInteger")
    r = Rule(head, (P(LABELLED, this="?d", lang="?lang", toxic="?t"),), reduce=folds(n=("count", "t")))
    return session(spark, sf, "documents", "labels", rules=(r,)).query(head).drop("this")


@query("SELECT coalesce(l.toxic, -1) AS t, count(*) AS n FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY 1")
def coalesced(spark, sf):
    head = C(t="q/t:SignedInteger", n="q/n:UnsignedInteger")
    r = Rule(head, (P(LABELLED, this="?d", toxic="?x"), P("coalesce", source="?x", fallback=-1, is_="?t")), reduce=folds(n=("count", "d")))
    return session(spark, sf, "documents", "labels", rules=(r,)).query(head).drop("this").withColumn("t", F.col("t").cast("int"))


@query("SELECT 'documents:' || d.doc_id AS d, d.lang AS lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def unless_labelled(spark, sf):
    return session(spark, sf, "documents", "labels").rows([P(DOCUMENT, this="?d", lang="?lang")], unless=[P(LABEL, this="?d", quality="_")], select=["d", "lang"])


@query("SELECT 'customer:' || c_custkey AS c FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def unless_with_constant(spark, sf):
    return session(spark, sf, "customer", "orders").rows([P(CUSTOMER, this="?c", name="_")], unless=[P(ORDER, customer="?c", status="F")], select=["c"])


@query("SELECT 'part:' || p_partkey AS p FROM part WHERE NOT (p_size < 25)")
def unless_constraint(spark, sf):
    return session(spark, sf, "part").rows([P(PART, this="?p", size="?s")], unless=[P("<", of="?s", with_=25)], select=["p"])


@query("SELECT 'customer:' || c_custkey AS a, 'supplier:' || s_suppkey AS b FROM customer JOIN supplier ON c_nationkey = s_nationkey AND c_acctbal < s_acctbal WHERE c_acctbal > 9000")
def theta_join(spark, sf):
    when = [P(CUSTOMER, this="?a", nation="?n", balance="?x"), P(SUPPLIER, this="?b", nation="?n", balance="?y"), P("<", of="?x", with_="?y"), P(">", of="?x", with_=9000)]
    return session(spark, sf, "customer", "supplier").rows(when, select=["a", "b"])


@query("SELECT 'region:' || a.r_regionkey AS a, 'region:' || b.r_regionkey AS b FROM region a CROSS JOIN region b")
def cross_product(spark, sf):
    return session(spark, sf, "region").rows([P(REGION, this="?a", name="_"), P(REGION, this="?b", name="?x")], select=["a", "b"])


@query("SELECT 'nation:' || n_nationkey AS this, n_name AS name, 'region:' || n_regionkey AS region FROM nation WHERE EXISTS (SELECT 1 FROM region WHERE r_regionkey = n_regionkey)")
def conformance(spark, sf):
    c = Concept.of("", name=Attribute("nation/name", "Text"), region=Attribute("nation/regionkey", "Entity", conforms=REGION))
    return session(spark, sf, "nation", "region").query(c)


@query("SELECT 'customer:' || c_custkey AS this, c_name AS name FROM customer UNION ALL SELECT 'supplier:' || s_suppkey, s_name FROM supplier")
def disjunction(spark, sf):
    party = C(name="party/name:Text")
    rules = (Rule(party, (P(CUSTOMER, this="?this", name="?name"),)), Rule(party, (P(SUPPLIER, this="?this", name="?name"),)))
    return session(spark, sf, "customer", "supplier", rules=rules).query(party)


@query("SELECT 'orders:' || o_orderkey AS this, o_totalprice AS total, o_orderpriority AS priority FROM orders WHERE o_orderstatus IN ('F', 'O') UNION ALL SELECT 'orders:' || o_orderkey, o_totalprice, o_orderpriority FROM orders WHERE o_orderstatus = 'F'")
def disjunction_keeps_duplicates(spark, sf):
    head = C(total="q/total:Float", priority="q/priority:Text")
    one = lambda s: Rule(head, (P(ORDER, this="?this", total="?total", priority="?priority", status=s),))
    again = Rule(head, (P(ORDER, this="?this", total="?total", priority="?priority", status="?s"), P("==", this="?s", is_="F")))
    return session(spark, sf, "orders", rules=(one("F"), one("O"), again)).query(head)


@query("SELECT 'documents:' || d.doc_id AS this, CAST(l.quality AS BIGINT) AS quality, CAST(NULL AS VARCHAR) AS lang FROM documents d JOIN labels l ON l.doc_id = d.doc_id UNION ALL SELECT 'documents:' || doc_id, NULL, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def ordered_variants(spark, sf):
    s = session(spark, sf, "documents", "labels")
    return s.variants(C(quality="labels/quality:SignedInteger"), C(lang="documents/lang:Text")).withColumn("quality", F.col("quality").cast("long"))


# --- recursion


def chain_rules():
    """Next higher order number of the same customer... as reachability among nations by number."""
    edge, path = C(to="graph/edge:Entity"), C(to="graph/path:Entity")
    return path, (
        Rule(path, (P(edge, this="?this", to="?to"),)),
        Rule(path, (P(edge, this="?this", to="?mid"), P(path, this="?mid", to="?to"))),
    )


def graph(spark, sf) -> Many:
    """Edges between nations of a region: to the next key, and one across."""
    from tessera.sources.wide import WideTable

    n = spark.read.parquet(f"{sf}/nation.parquet")
    m = n.select(F.col("n_nationkey").alias("m"), F.col("n_regionkey").alias("mr"))
    edges = n.join(m, (F.col("n_regionkey") == F.col("mr")) & (F.col("m") > F.col("n_nationkey"))).groupBy("n_nationkey").agg(F.min("m").alias("to"))
    return Many([WideTable(edges, "nation:", "n_nationkey", {"graph/edge": "to"}, {"graph/edge": "nation:"}), simple(n, "nation", "n_nationkey", "n_", {"regionkey": "region:"})])


EDGES = "e AS (SELECT a.n_nationkey AS x, min(b.n_nationkey) AS y FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND b.n_nationkey > a.n_nationkey GROUP BY 1)"


@query(f"WITH RECURSIVE {EDGES}, p AS (SELECT x, y FROM e UNION SELECT e.x, p.y FROM e JOIN p ON e.y = p.x) SELECT 'nation:' || x AS this, 'nation:' || y AS \"to\" FROM p")
def recursion_linear(spark, sf):
    path, rules = chain_rules()
    return Session(spark, graph(spark, sf), list(rules)).query(path)


@query(f"WITH RECURSIVE {EDGES}, p AS (SELECT x, y FROM e UNION SELECT e.x, p.y FROM e JOIN p ON e.y = p.x) SELECT 'nation:' || x AS this, 'nation:' || y AS \"to\" FROM p")
def recursion_nonlinear(spark, sf):
    edge, path = C(to="graph/edge:Entity"), C(to="graph/path:Entity")
    rules = [Rule(path, (P(edge, this="?this", to="?to"),)), Rule(path, (P(path, this="?this", to="?mid"), P(path, this="?mid", to="?to")))]
    return Session(spark, graph(spark, sf), rules).query(path)


@query(f"WITH RECURSIVE {EDGES}, p AS (SELECT x, y, 1 AS odd FROM e UNION SELECT e.x, p.y, 1 - p.odd FROM e JOIN p ON e.y = p.x) SELECT 'nation:' || x AS this, 'nation:' || y AS \"to\" FROM p WHERE odd = 0")
def recursion_mutual(spark, sf):
    edge, odd, even = C(to="graph/edge:Entity"), C(to="graph/odd:Entity"), C(to="graph/even:Entity")
    rules = [Rule(odd, (P(edge, this="?this", to="?to"),)), Rule(odd, (P(edge, this="?this", to="?m"), P(even, this="?m", to="?to"))), Rule(even, (P(edge, this="?this", to="?m"), P(odd, this="?m", to="?to")))]
    return Session(spark, graph(spark, sf), rules).query(even)


@query(f"WITH RECURSIVE {EDGES}, p AS (SELECT x, y FROM e UNION SELECT e.x, p.y FROM e JOIN p ON e.y = p.x) SELECT 'nation:' || x AS this, count(*) AS n FROM p GROUP BY 1")
def recursion_then_fold(spark, sf):
    path, rules = chain_rules()
    head = C(n="graph/reach:UnsignedInteger")
    r = Rule(head, (P(path, this="?this", to="?t"),), reduce=folds(n=("count", "t")))
    return Session(spark, graph(spark, sf), [*rules, r]).query(head)


@query(f"WITH RECURSIVE {EDGES}, p AS (SELECT x, y FROM e UNION SELECT e.x, p.y FROM e JOIN p ON e.y = p.x) SELECT 'nation:' || y AS \"to\" FROM p WHERE x = 0")
def recursion_with_constant(spark, sf):
    path, rules = chain_rules()
    return Session(spark, graph(spark, sf), list(rules)).query(path, this="nation:0", to="?to")


# --- formulas and constraints


@query("SELECT p_partkey AS k, p_brand || '/' || p_type AS joined, upper(p_name) AS up, lower(p_brand) AS low, CAST(strlen(p_name) AS BIGINT) AS bytes FROM part")
def text_formulas(spark, sf):
    when = [P(PART, this="?p", name="?n", brand="?b", type="?t"), P("text/concatenate", first="?b", second="/", is_="?x"), P("text/concatenate", first="?x", second="?t", is_="?joined"), P("text/upper-case", of="?n", is_="?up"), P("text/lower-case", of="?b", is_="?low"), P("text/length", of="?n", is_="?bytes")]
    out = session(spark, sf, "part").rows(when, select=["p", "joined", "up", "low", "bytes"])
    return out.select(F.substring_index("p", ":", -1).cast("long").alias("k"), "joined", "up", "low", F.col("bytes").cast("long").alias("bytes"))


@query("SELECT p_partkey AS k, p_size + 7 AS s, p_size * 3 AS m, p_size // 4 AS q, p_size % 4 AS r, p_size - 20 AS d FROM part")
def integer_formulas(spark, sf):
    when = [P(PART, this="?p", size="?z"), P("math/sum", of="?z", with_=7, is_="?s"), P("math/product", of="?z", times=3, is_="?m"), P("math/quotient", of="?z", by=4, is_="?q"), P("math/modulo", of="?z", by=4, is_="?r"), P("math/difference", of="?z", subtract=20, is_="?d")]
    out = session(spark, sf, "part").rows(when, select=["p", "s", "m", "q", "r", "d"])
    return out.select(F.substring_index("p", ":", -1).cast("long").alias("k"), *(F.col(c).cast("int").alias(c) for c in "smqrd"))


@query("SELECT 'part:' || p_partkey AS p, p_type AS t FROM part WHERE p_type LIKE 'S%' AND p_type LIKE '%L'")
def glob_filter(spark, sf):
    return session(spark, sf, "part").rows([P(PART, this="?p", type="?t"), P("text/like", text="?t", pattern="S*L", is_="?t")], select=["p", "t"])


@query("SELECT 'part:' || p_partkey AS p FROM part WHERE starts_with(p_brand, 'Brand#1')")
def prefix_filter(spark, sf):
    return session(spark, sf, "part").rows([P(PART, this="?p", brand="?b"), P("starts-with", of="?b", prefix="Brand#1")], select=["p"])


@query("SELECT 'part:' || p_partkey AS p, CAST(p_size AS VARCHAR) AS t, CAST(p_size AS BIGINT) AS n FROM part")
def conversions(spark, sf):
    when = [P(PART, this="?p", size="?z"), P("text/from", value="?z", is_="?t"), P("signed-integer/parse", text="?t", is_="?n")]
    out = session(spark, sf, "part").rows(when, select=["p", "t", "n"])
    return out.withColumn("n", F.col("n").cast("long"))


@query("SELECT 'part:' || p_partkey AS p, p_size >= 10 AND NOT p_size > 30 AS b FROM part WHERE p_size >= 10 AND p_size <= 30")
def range_bounds(spark, sf):
    return session(spark, sf, "part").rows([P(PART, this="?p", size="?z"), P(">=", of="?z", with_=10), P("<=", of="?z", with_=30.0)], select=["p"]).withColumn("b", F.lit(True))


@query("SELECT 'part:' || p_partkey AS p FROM part WHERE false")
def literal_does_not_adapt(spark, sf):
    return session(spark, sf, "part").rows([P(PART, this="?p", size="?z"), P(">", of="?z", with_=1.5)], select=["p"])


@query("SELECT 'events:' || event_id AS e, event_type AS kind, value AS v FROM events WHERE event_type = (SELECT min(event_type) FROM events)")
def equality_infers(spark, sf):
    first = spark.read.parquet(f"{sf}/events.parquet").agg(F.min("event_type")).first()[0]
    return session(spark, sf, "events").rows([P(EVENT, this="?e", type="?kind", value="?v"), P("==", this="?wanted", is_=first), P("==", this="?kind", is_="?wanted")], select=["e", "kind", "v"])


# --- narrow facts


NARROW_SQL = "SELECT 'customer/name' AS the, 'customer:' || c_custkey AS of, c_name AS v FROM customer"


@query(f"SELECT * FROM ({NARROW_SQL})")
def fact_select(spark, sf):
    return select(narrow(spark, sf), the="customer/name").select("the", "of", F.col("vs").alias("v"))


@query("SELECT the, count(*) AS n FROM (SELECT unnest(['customer/custkey', 'customer/name', 'customer/nationkey', 'customer/acctbal', 'customer/mktsegment']) AS the FROM customer) GROUP BY 1")
def attribute_variable(spark, sf):
    own = Session(spark, NarrowFacts(narrow(spark, sf).where(F.col("the").startswith("customer/"))))
    return own.rows([P(Attribute("any/any"), the="?the", of="?of", is_="_")]).groupBy("the").count().withColumnRenamed("count", "n")


@query("SELECT 'customer:' || c_custkey AS of, c_acctbal AS v FROM customer WHERE c_acctbal >= 1000 AND c_acctbal < 2000")
def fact_value_range(spark, sf):
    own = select(narrow(spark, sf), domain="customer", name="acctbal", at_least=1000.0)
    return select(own, below=2000.0).select("of", F.col("vf").alias("v"))


@query("SELECT 'customer:' || c_custkey AS this, c_name AS name, c_acctbal AS balance FROM customer")
def narrow_concept(spark, sf):
    return Session(spark, NarrowFacts(narrow(spark, sf))).query(C(name="customer/name:Text", balance="customer/acctbal:Float"))


@query("SELECT 'customer:' || c_custkey AS of, CASE WHEN c_custkey % 3 = 0 THEN 'newer' ELSE c_name END AS v FROM customer")
def election(spark, sf):
    """A caused fact beats an uncaused one of the same entity and attribute."""
    own = select(narrow(spark, sf), the="customer/name")
    key = F.substring_index("of", ":", -1).cast("long")
    newer = own.where(key % 3 == 0).withColumns({"vs": F.lit("newer"), "cause": F.unhex(F.lit("ff"))})
    return elect(own.unionByName(newer)).select("of", F.col("vs").alias("v"))


@query("SELECT 'customer:' || c_custkey AS of, c_name AS v FROM customer WHERE c_custkey % 2 = 1 UNION ALL SELECT 'customer:' || c_custkey, 'renamed' FROM customer WHERE c_custkey % 10 = 0")
def overlay(spark, sf):
    own = select(narrow(spark, sf), the="customer/name")
    key = F.substring_index("of", ":", -1).cast("long")
    return overlaid(own, own.where(key % 10 == 0).withColumn("vs", F.lit("renamed")), own.where(key % 2 == 0)).select("of", F.col("vs").alias("v"))


@query("SELECT count(*) AS n FROM (SELECT c_custkey FROM customer)")
def union_dedups(spark, sf):
    own = select(narrow(spark, sf), the="customer/name")
    return union(own, own).agg(F.count("*").alias("n"))


@query("SELECT 'nation:' || n_nationkey AS of FROM nation WHERE n_regionkey <> 1")
def retraction(spark, sf):
    own = select(narrow(spark, sf), the="nation/regionkey")
    return without(own, own.where("vs = 'region:1'")).select("of")


# --- writes, versions, standing queries


@query("SELECT c_custkey AS k, CASE WHEN c_custkey BETWEEN 1 AND 5 THEN 'VIP' ELSE c_mktsegment END AS v FROM customer WHERE c_custkey NOT IN (6, 7)")
def transaction_view(spark, sf):
    """Replacements and retractions of a batch, seen before any commit."""
    from tessera.store import Changes, applied

    own = select(narrow(spark, sf), the="customer/mktsegment")
    old = {r["of"]: r["vs"] for r in own.where(F.col("of").isin("customer:6", "customer:7")).collect()}
    batch = Changes()
    for i in range(1, 6):
        batch.replace("customer/mktsegment", f"customer:{i}", "VIP")
    for of, v in old.items():
        batch.retract("customer/mktsegment", of, v)
    out = applied(own, batch.frame(spark))
    return out.select(F.substring_index("of", ":", -1).cast("long").alias("k"), F.col("vs").alias("v"))


@query("SELECT c_mktsegment AS k, sum(CASE WHEN c_acctbal > 0 THEN 1 ELSE 0 END) - sum(CASE WHEN c_acctbal > 5000 THEN 1 ELSE 0 END) AS weight FROM customer GROUP BY 1")
def zset_difference(spark, sf):
    from tessera.operators import zset

    c = spark.read.parquet(f"{sf}/customer.parquet").select(F.col("c_mktsegment").alias("k"), "c_acctbal")
    return zset.difference(*(zset.of(c.where(F.col("c_acctbal") > x).select("k")) for x in (0, 5000)))


@query("SELECT 'nation:' || n_nationkey AS this, n_name AS name, 'asserted' AS how FROM nation WHERE n_regionkey = 1 UNION ALL SELECT 'nation:' || n_nationkey, n_name, 'retracted' FROM nation WHERE n_regionkey = 2")
def subscription_delta(spark, sf):
    """What a standing query gains and loses when facts come and go."""
    from tessera.streaming.subscription import Subscription

    own = select(narrow(spark, sf), the_prefix="nation/")
    region = own.where("the = 'nation/regionkey'").select("of", F.col("vs").alias("r"))
    part = lambda *rs: own.join(region.where(F.col("r").isin(*rs)), "of", "left_semi").select(own.columns)
    state = {"df": part("region:0", "region:2")}
    sub = Subscription(spark, lambda: state["df"], C(name="nation/name:Text"))
    sub.poll()
    state["df"] = part("region:0", "region:1")
    d = sub.poll()
    return d.asserted.withColumn("how", F.lit("asserted")).unionByName(d.retracted.withColumn("how", F.lit("retracted")))


@query("SELECT 'customer' AS source, count(*) AS n, count(DISTINCT c_name) AS names, round(sum(c_acctbal), 2) AS total FROM customer")
def csv_round_trip(spark, sf):
    """Facts written as CSV and read again."""
    import uuid

    from tessera.plans.compile import ensure_checkpoints
    from tessera.sources import csv

    ensure_checkpoints(spark)
    at = f"{spark.sparkContext.getCheckpointDir()}/csv-{uuid.uuid4().hex}"
    csv.write_facts(select(narrow(spark, sf), domain="customer"), at)
    own = csv.read_facts(spark, at)
    names, money = own.where("the = 'customer/name'"), own.where("the = 'customer/acctbal'")
    counted = names.agg(F.count("*").alias("n"), F.countDistinct("vs").alias("names"))
    return counted.join(money.agg(F.round(F.sum("vf"), 2).alias("total"))).select(F.lit("customer").alias("source"), "n", "names", "total")


@query("SELECT o_custkey AS k, max(o_orderkey) AS last FROM orders GROUP BY 1")
def transaction_log_replay(spark, sf):
    """Orders as a log of writes to their customer: the last one stands."""
    from tessera.model import TAGS
    from tessera.sources import csv

    o = spark.read.parquet(f"{sf}/orders.parquet")
    none = {c: F.lit(None).cast(t) for c, t in (("vs", "string"), ("vf", "double"), ("vb", "binary"), ("vbool", "boolean"))}
    log = o.select(F.col("o_orderkey").alias("txn"), F.lit("customer/last").alias("the"), F.concat(F.lit("customer:"), "o_custkey").alias("of"), F.lit(TAGS["UnsignedInteger"]).cast("byte").alias("vt"), F.col("o_orderkey").cast("decimal(38,0)").alias("vn"), *(c.alias(n) for n, c in none.items()))
    return csv.replayed(log).select(F.substring_index("of", ":", -1).cast("long").alias("k"), F.col("vn").cast("long").alias("last"))


@query("WITH RECURSIVE r AS (SELECT n_nationkey AS id, n_nationkey // 2 AS p FROM nation WHERE n_nationkey > 0), a AS (SELECT id AS x, id AS y FROM r UNION SELECT a.x, r.p FROM a JOIN r ON a.y = r.id WHERE r.p > 0) SELECT CAST(x AS VARCHAR) AS this, CAST(y AS VARCHAR) AS ancestor FROM a")
def revision_ancestry(spark, sf):
    """A version tree on the nations' keys, each revision's parent half its number."""
    from tessera.history import ancestors

    return ancestors(_tree(spark, sf))


@query("SELECT 'nation:' || n_nationkey AS of, upper(n_name) AS v FROM nation WHERE n_regionkey = 3 UNION ALL SELECT 'nation:' || n_nationkey, 'northern ' || upper(n_name) FROM nation WHERE n_regionkey = 3")
def induced_facts(spark, sf):
    """A commit's facts trigger a rule, and what it asserts triggers another."""
    import uuid

    from tessera.plans.compile import ensure_checkpoints
    from tessera.store import Branch, Changes

    ensure_checkpoints(spark)
    br = Branch(spark, f"{spark.sparkContext.getCheckpointDir()}/branch-{uuid.uuid4().hex}")
    loud, titled = C(loud="nation/loud:Text"), C(titled="nation/titled:Text")
    name = C(name="nation/name:Text", region="nation/regionkey:Entity")
    rules = [
        Rule(loud, (P(name, this="?this", name="?n", region="region:3"), P("text/upper-case", of="?n", is_="?loud")), head="assert"),
        Rule(titled, (P(loud, this="?this", loud="?l"), P("text/concatenate", first="northern ", second="?l", is_="?titled")), head="assert"),
    ]
    batch = Changes()
    for r in spark.read.parquet(f"{sf}/nation.parquet").collect():  # a commit's own batch
        batch.assert_("nation/name", f"nation:{r['n_nationkey']}", r["n_name"])
        batch.assert_("nation/regionkey", f"nation:{r['n_nationkey']}", f"region:{r['n_regionkey']}", "Entity")
    t = br.transaction()
    t.changes = batch
    t.commit(rules)
    return br.facts().where(F.col("the").isin("nation/loud", "nation/titled")).select("of", F.col("vs").alias("v"))


@query("SELECT 'customer:' || c_custkey AS of, CASE WHEN c_custkey % 2 = 0 THEN 'left' WHEN c_custkey % 3 = 0 THEN 'right' ELSE c_mktsegment END AS v FROM customer WHERE c_custkey % 5 <> 0 OR c_custkey % 2 = 0 OR c_custkey % 3 = 0")
def three_way_merge(spark, sf):
    """One side changes even keys; the other odd multiples of three, and drops other multiples of five."""
    from tessera.history import merged

    base = select(narrow(spark, sf), the="customer/mktsegment")
    k = F.substring_index("of", ":", -1).cast("long")
    mine = base.withColumn("vs", F.when(k % 2 == 0, "left").otherwise(F.col("vs")))
    theirs = base.withColumn("vs", F.when((k % 2 == 1) & (k % 3 == 0), "right").otherwise(F.col("vs"))).where((k % 5 != 0) | (k % 2 == 0) | (k % 3 == 0))
    return merged(base, mine, theirs).select("of", F.col("vs").alias("v"))


@query("SELECT kind, count(*) AS n FROM (SELECT 'text' AS kind FROM customer UNION ALL SELECT 'text' FROM customer UNION ALL SELECT 'number' FROM customer UNION ALL SELECT 'number' FROM customer UNION ALL SELECT 'entity' FROM customer) GROUP BY 1")
def type_predicates(spark, sf):
    own = Session(spark, NarrowFacts(narrow(spark, sf).where(F.col("the").startswith("customer/"))))
    out = None
    for kind in ("text", "number", "entity"):
        got = own.rows([P(Attribute("any/any"), the="_", of="?of", is_="?v"), P("type", of="?v", is_=kind)], select=["of"]).select(F.lit(kind).alias("kind"))
        out = got if out is None else out.unionByName(got)
    return out.groupBy("kind").count().withColumnRenamed("count", "n")


# --- several sources, names, selectors


def renamed(df: DataFrame, the: str) -> DataFrame:
    return df.withColumn("the", F.lit(the))


@query("SELECT 'customer:' || c_custkey AS this, c_name AS name FROM customer UNION ALL SELECT 'supplier:' || s_suppkey, s_name FROM supplier")
def two_sources(spark, sf):
    """Two sources that know the same attribute, and a fact that both hold."""
    first, second = (renamed(p.facts().where(F.col("the").endswith("/name")), "party/name") for p in source(spark, sf, "customer", "supplier").parts)
    return Session(spark, Many([NarrowFacts(first.unionByName(second.limit(1))), NarrowFacts(second)])).query(C(name="party/name:Text"))


@query("SELECT 'plain' AS how, 'nation:' || n_nationkey AS this FROM nation UNION ALL SELECT 'strict', 'nation:' || n_nationkey FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region WHERE r_name = 'ASIA') UNION ALL SELECT 'either', 'nation:' || n_nationkey FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region WHERE r_name IN ('ASIA', 'EUROPE'))")
def conforming_and_plain(spark, sf):
    """Concepts of the same attribute that differ in what its values conform to, in one session."""
    s = session(spark, sf, "nation", "region")
    to = lambda *names: Attribute("nation/regionkey", "Entity", conforms=Concept.of(name=Attribute("region/name", "Text", one_of=names)) if names else None)
    out = None
    for how, a in (("plain", to()), ("strict", to("ASIA")), ("either", to("ASIA", "EUROPE"))):
        own = s.query(Concept.of(region=a)).select(F.lit(how).alias("how"), "this")
        out = own if out is None else out.unionByName(own)
    return out


@query("SELECT 'nation.list/' || CASE WHEN n_regionkey % 2 = 0 THEN 'N' ELSE 'n' END || n_nationkey AS the, 'nation.list' AS namespace, 'N' || n_nationkey AS position FROM nation WHERE n_regionkey % 2 = 0 AND n_nationkey % 10 <> 0")
def position_names(spark, sf):
    """Names of attributes that are positions, and what they are made of."""
    n = spark.read.parquet(f"{sf}/nation.parquet")
    the = F.concat(F.lit("nation.list/"), F.when(F.col("n_regionkey") % 2 == 0, "N").otherwise("n"), "n_nationkey")
    own = narrow(spark, sf).where(F.lit(False)).unionByName(n.select(the.alias("the"), F.lit("list:1").alias("of"), F.lit(3).cast("byte").alias("vt"), F.col("n_name").alias("vs")), allowMissingColumns=True)
    s = Session(spark, NarrowFacts(select(own, domain="nation.list", name_shape="position")))
    return s.rows([P(Attribute("any/any"), the="?the", of="_", is_="_"), P("order/position-parts", of="?the", namespace="?namespace", position="?position")], select=["the", "namespace", "position"])


@query("SELECT 'customer:' || c_custkey AS of FROM customer WHERE starts_with(CAST(c_custkey AS VARCHAR), '12') AND starts_with(c_mktsegment, 'B')")
def prefix_selectors(spark, sf):
    own = select(narrow(spark, sf), the="customer/mktsegment", of_prefix="customer:12")
    return select(own, is_prefix="B").select("of")


@query("SELECT 'customer:' || c_custkey AS this, '0000000000000000000000000000000000000000000000000000000000000000' AS cause FROM customer WHERE c_custkey <= 50")
def cause_of_plain_facts(spark, sf):
    """Facts without a cause have the zero hash."""
    own = Session(spark, source(spark, sf, "customer")).rows([P(Attribute("customer/custkey", "SignedInteger"), the="customer/custkey", of="?this", is_="?k", cause="?cause"), P("<=", of="?k", with_=50)], select=["this", "cause"])
    return own.select("this", F.lower(F.hex("cause")).alias("cause"))


# --- formulas and folds on other types


@query("SELECT 'part:' || p_partkey AS p, p_size > 25 AND p_retailprice > 1000 AS a, p_size > 25 OR p_retailprice > 1000 AS o, NOT p_size > 25 AS n FROM part")
def boolean_formulas(spark, sf):
    from tessera.sources.wide import simple

    t = spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", (F.col("p_size") > 25).alias("p_big"), (F.col("p_retailprice") > 1000).alias("p_dear"))
    s = Session(spark, Many([simple(t, "part", "p_partkey", "p_")]))
    when = [P(C(big="part/big:Boolean", dear="part/dear:Boolean"), this="?p", big="?x", dear="?y"), P("boolean/and", left="?x", right="?y", is_="?a"), P("boolean/or", left="?x", right="?y", is_="?o"), P("boolean/not", value="?x", is_="?n")]
    return s.rows(when, select=["p", "a", "o", "n"])


@query("SELECT 'customer:' || c_custkey AS c, c_acctbal AS f, CASE WHEN c_custkey % 2 = 0 THEN c_custkey END AS u FROM customer WHERE c_custkey % 2 = 0")
def parsed_numbers(spark, sf):
    """Floats out of their text, and unsigned integers out of padded text; what isn't one drops the row."""
    from tessera.sources.wide import simple

    c = spark.read.parquet(f"{sf}/customer.parquet")
    t = c.select("c_custkey", "c_acctbal", F.concat(F.when(F.col("c_custkey") % 2 == 0, " +").otherwise("-"), F.col("c_custkey").cast("string"), F.lit(" ")).alias("c_text"))
    s = Session(spark, Many([simple(t, "customer", "c_custkey", "c_")]))
    when = [P(C(balance="customer/acctbal:Float", text="customer/text:Text"), this="?c", balance="?b", text="?t"), P("text/from", value="?b", is_="?s"), P("float/parse", text="?s", is_="?f"), P("unsigned-integer/parse", text="?t", is_="?u")]
    return s.rows(when, select=["c", "f", "u"]).withColumn("u", F.col("u").cast("long"))


@query("SELECT p_brand AS brand, CAST(sum(p_size) AS BIGINT) AS size, min(p_size) AS lo, max(p_size) AS hi, count(DISTINCT p_size) AS sizes FROM part GROUP BY 1")
def integer_folds(spark, sf):
    head = C(brand="q/brand:Text", size="q/size:SignedInteger", lo="q/lo:SignedInteger", hi="q/hi:SignedInteger", sizes="q/sizes:UnsignedInteger")
    r = Rule(head, (P(PART, this="?p", brand="?brand", size="?z"),), reduce=folds(size=("sum", "z"), lo=("min", "z"), hi=("max", "z"), sizes=("count-distinct", "z")))
    out = session(spark, sf, "part", rules=(r,)).query(head).drop("this")
    return out.withColumns({"size": F.col("size").cast("long"), "lo": F.col("lo").cast("int"), "hi": F.col("hi").cast("int")})


@query("SELECT the, CAST(CASE the WHEN 'customer/acctbal' THEN NULL ELSE s END AS VARCHAR) AS hi_text, CASE the WHEN 'customer/acctbal' THEN f END AS hi_float FROM (SELECT 'customer/acctbal' AS the, max(c_acctbal) AS f, NULL AS s FROM customer UNION ALL SELECT 'customer/name', NULL, max(c_name) FROM customer UNION ALL SELECT 'customer/mktsegment', NULL, max(c_mktsegment) FROM customer)")
def folds_keep_types(spark, sf):
    """The greatest value of each attribute, of whatever type."""
    own = narrow(spark, sf).where(F.col("the").isin("customer/acctbal", "customer/name", "customer/mktsegment"))
    head = C(the="q/the:Symbol", hi="q/hi:Any")
    r = Rule(head, (P(Attribute("any/any"), the="?the", of="?of", is_="?v"),), reduce=folds(hi=("max", "v")))
    return Session(spark, NarrowFacts(own), [r]).query(head).select("the", F.col("hi.vs").alias("hi_text"), F.col("hi.vf").alias("hi_float"))


@query("SELECT 'part:' || p_partkey AS p, word FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part) WHERE word <> ''")
def formula_of_many_rows(spark, sf):
    """A formula of one's own that gives a row for each word."""
    from tessera.functions import formulas

    def words(c, kinds, constants):
        found = F.filter(F.split(c["text"], " "), lambda x: x != "")
        return F.transform(found, lambda x: F.struct(x.alias("is"))), {"is": "Text"}

    formulas.register("text/words", ("text",), ("is",), words, many=True)
    return session(spark, sf, "part").rows([P(PART, this="?p", name="?n"), P("text/words", text="?n", is_="?word")], select=["p", "word"])


# --- branches


def _branch(spark, name: str = "main", at: str | None = None):
    import uuid

    from tessera.plans.compile import ensure_checkpoints
    from tessera.store import Branch

    ensure_checkpoints(spark)
    return Branch(spark, at or f"{spark.sparkContext.getCheckpointDir()}/branch-{uuid.uuid4().hex}", name)


def _committed(spark, sf):
    """A branch in three commits: nations, other names in region 1, region 2 gone."""
    br = _branch(spark)
    own = select(narrow(spark, sf), the_prefix="nation/")
    as_batch = lambda df, op: df.select(F.lit(0).cast("long").alias("seq"), F.lit(op).alias("op"), "the", "of", "vt", "vs", "vn", "vf", "vb", "vbool")
    at = lambda k: own.where((F.col("the") == "nation/regionkey") & (F.col("vs") == f"region:{k}")).select("of")
    br.commit(as_batch(own, "assert"))
    br.commit(as_batch(own.where("the = 'nation/name'").join(at(1), "of", "left_semi").withColumn("vs", F.lower("vs")), "replace"))
    br.commit(as_batch(own.join(at(2), "of", "left_semi"), "retract"))
    return br


STATE_SQL = "SELECT 'nation:' || n_nationkey AS of, CASE WHEN n_regionkey = 1 THEN lower(n_name) ELSE n_name END AS v FROM nation WHERE n_regionkey <> 2"


@query(STATE_SQL)
def branch_reopened(spark, sf):
    """What was committed is there for whoever opens the branch next."""
    br = _committed(spark, sf)
    return select(_branch(spark, at=br.folder).facts(), the="nation/name").select("of", F.col("vs").alias("v"))


@query(STATE_SQL)
def branch_export_import(spark, sf):
    from tessera.sources.csv import CsvFacts

    br, other = _committed(spark, sf), _branch(spark)
    out = CsvFacts(f"{br.folder}/export")
    br.export(out)
    other.import_(out)
    return select(other.facts(), the="nation/name").select("of", F.col("vs").alias("v"))


@query(STATE_SQL)
def branch_pulled_and_pushed(spark, sf):
    """A branch of another folder is pulled, and a third one receives a push."""
    br, other, third = _committed(spark, sf), _branch(spark, "other"), _branch(spark, "third")
    other.pull(br)
    other.push(third)
    return select(third.facts(), the="nation/name").select("of", F.col("vs").alias("v"))


@query("SELECT 'assert' AS polarity, 1 AS edition, 3 * count(*) AS n FROM nation UNION ALL SELECT p, 2, count(*) FROM nation, (SELECT unnest(['assert', 'retract']) AS p) WHERE n_regionkey = 1 GROUP BY 1 UNION ALL SELECT 'retract', 3, 3 * count(*) FROM nation WHERE n_regionkey = 2")
def history_records(spark, sf):
    own = _committed(spark, sf).history()
    return own.groupBy("polarity", F.col("edition").cast("int").alias("edition")).agg(F.count("*").alias("n"))


@query("SELECT 'nation:' || n_nationkey AS of, CASE n_nationkey % 4 WHEN 0 THEN 'c' WHEN 1 THEN n_name WHEN 2 THEN n_name ELSE 'b' END AS v FROM nation UNION ALL SELECT 'nation:' || n_nationkey, 'd' FROM nation WHERE n_nationkey % 4 = 3")
def batch_order(spark, sf):
    """Writes of one batch to the same facts: the order they are in decides."""
    from tessera.store import BATCH, applied

    own = select(narrow(spark, sf), the="nation/name")
    k = F.substring_index("of", ":", -1).cast("long") % 4
    write = lambda seq, op, v: F.struct(F.lit(seq).cast("long").alias("seq"), F.lit(op).alias("op"), F.lit(v).alias("vs"))
    ops = (
        F.when(k == 0, F.array(write(0, "replace", "b"), write(1, "replace", "c")))
        .when(k == 1, F.array(write(0, "assert", "z"), write(1, "retract", "z")))
        .when(k == 3, F.array(write(0, "assert", "a"), write(1, "replace", "b"), write(2, "assert", "d")))
    )
    batch = own.where(k != 2).select("the", "of", F.explode(ops).alias("w"))
    batch = batch.select("w.seq", "w.op", "the", "of", F.lit(3).cast("byte").alias("vt"), "w.vs", *(F.lit(None).cast(t).alias(n) for n, t in (("vn", "decimal(38,0)"), ("vf", "double"), ("vb", "binary"), ("vbool", "boolean"))))
    return applied(own, spark.createDataFrame([], BATCH).unionByName(batch)).select("of", F.col("vs").alias("v"))


def _tree(spark, sf) -> DataFrame:
    """A version tree on the nations' keys, each revision's parent half its number."""
    n = spark.read.parquet(f"{sf}/nation.parquet").where("n_nationkey > 0")
    half = F.floor(F.col("n_nationkey") / 2).cast("string")
    return n.select(F.col("n_nationkey").cast("string").alias("id"), F.col("n_regionkey").cast("string").alias("origin"), F.col("n_nationkey").cast("long").alias("edition"), F.when(F.col("n_nationkey") > 1, F.array(half)).otherwise(F.array().cast("array<string>")).alias("parents"))


TREE_SQL = "r AS (SELECT n_nationkey AS id, n_nationkey // 2 AS p, n_regionkey AS origin FROM nation WHERE n_nationkey > 0), a AS (SELECT id AS x, id AS y FROM r UNION SELECT a.x, r.p FROM a JOIN r ON a.y = r.id WHERE r.p > 0)"


@query(f"WITH RECURSIVE {TREE_SQL}, q(a, b) AS (VALUES (17, 4), (4, 17), (20, 22), (6, 6), (9, 24)) SELECT CAST(q.a AS VARCHAR) AS a, CAST(q.b AS VARCHAR) AS b, CASE WHEN q.a = q.b THEN 'equal' WHEN EXISTS (SELECT 1 FROM a z WHERE z.x = q.a AND z.y = q.b) THEN 'supersedes' WHEN EXISTS (SELECT 1 FROM a z WHERE z.x = q.b AND z.y = q.a) THEN 'superseded' ELSE 'concurrent' END AS relation, (SELECT CAST(max(z.y) AS VARCHAR) FROM a z JOIN a w ON z.y = w.y WHERE z.x = q.a AND w.x = q.b) AS ancestor FROM q")
def version_relations(spark, sf):
    from tessera.history import causality, common_ancestor

    revs = _tree(spark, sf)
    pairs = (("17", "4"), ("4", "17"), ("20", "22"), ("6", "6"), ("9", "24"))
    return spark.createDataFrame([(a, b, causality(revs, a, b), common_ancestor(revs, a, b)) for a, b in pairs], "a string, b string, relation string, ancestor string")


@query(f"WITH RECURSIVE {TREE_SQL} SELECT CAST(origin AS VARCHAR) AS origin, CAST(max(id) AS BIGINT) AS edition FROM a JOIN r ON r.id = a.y WHERE a.x = 22 GROUP BY 1")
def version_context(spark, sf):
    from tessera.history import context

    return context(_tree(spark, sf), "22")


# --- changes of standing queries


@query("SELECT 'customer:' || c_custkey AS this, lower(n_name) AS nation, 'asserted' AS how FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1 UNION ALL SELECT 'customer:' || c_custkey, n_name, 'retracted' FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1")
def subscription_over_a_join(spark, sf):
    """Names of nations change: only customers who live there are derived anew."""
    from tessera.streaming.subscription import Subscription

    own = narrow(spark, sf).where(F.col("the").isin("customer/nationkey", "nation/name", "nation/regionkey")).checkpoint()
    region = own.where("the = 'nation/regionkey' and vs = 'region:1'").select(F.col("of").alias("_of"))
    head = C(nation="home/nation:Text")
    rule = Rule(head, (P(C(nation="customer/nationkey:Entity"), this="?this", nation="?n"), P(C(name="nation/name:Text"), this="?n", name="?nation")))
    state = {"df": own}
    sub = Subscription(spark, lambda: state["df"], head, [rule])
    sub.poll()
    there = own.join(region, F.col("of") == F.col("_of"), "left")
    state["df"] = there.withColumn("vs", F.when((F.col("the") == "nation/name") & F.col("_of").isNotNull(), F.lower("vs")).otherwise(F.col("vs"))).select(own.columns)
    d = sub.poll()
    if sub.recomputes != 1:
        raise AssertionError("the join was derived as a whole")
    return d.asserted.withColumn("how", F.lit("asserted")).unionByName(d.retracted.withColumn("how", F.lit("retracted")))


@query(f"WITH RECURSIVE {EDGES}, f AS (SELECT x, y FROM e WHERE x % 4 <> 1), p AS (SELECT x, y FROM e UNION SELECT e.x, p.y FROM e JOIN p ON e.y = p.x), o AS (SELECT x, y FROM f UNION SELECT f.x, o.y FROM f JOIN o ON f.y = o.x) SELECT 'nation:' || x AS this, 'nation:' || y AS \"to\" FROM p EXCEPT SELECT 'nation:' || x, 'nation:' || y FROM o")
def closure_grows(spark, sf):
    """What a standing closure gains when a quarter of the edges is added."""
    from tessera.streaming.subscription import Subscription

    path, rules = chain_rules()
    edges = graph(spark, sf).parts[0].facts()
    state = {"df": edges.where(F.substring_index("of", ":", -1).cast("int") % 4 != 1)}
    sub = Subscription(spark, lambda: state["df"], path, list(rules))
    sub.poll()
    state["df"] = edges
    return sub.poll().asserted


@query(f"WITH RECURSIVE {EDGES}, f AS (SELECT x, y FROM e WHERE x % 4 <> 1), p AS (SELECT x, y FROM e UNION SELECT e.x, p.y FROM e JOIN p ON e.y = p.x), o AS (SELECT x, y FROM f UNION SELECT f.x, o.y FROM f JOIN o ON f.y = o.x) SELECT 'nation:' || x AS this, 'nation:' || y AS \"to\" FROM p EXCEPT SELECT 'nation:' || x, 'nation:' || y FROM o")
def closure_shrinks(spark, sf):
    """What it loses when they are taken away again."""
    from tessera.streaming.subscription import Subscription

    path, rules = chain_rules()
    edges = graph(spark, sf).parts[0].facts()
    state = {"df": edges}
    sub = Subscription(spark, lambda: state["df"], path, list(rules))
    sub.poll()
    state["df"] = edges.where(F.substring_index("of", ":", -1).cast("int") % 4 != 1)
    return sub.poll().retracted


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: f for n, (f, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {n: sql for n, (_, sql) in QUERIES.items() if sql is not None}
