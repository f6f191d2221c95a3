"""Registered data-job queries (validation, quality, admission, state rules, backfills, writes)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.functions.text import slug
from ledgerloom.operators import admission as G
from ledgerloom.operators import backfill as B
from ledgerloom.operators import quality as Q
from ledgerloom.plans.catalog import AS_OF, D, LINES, register, with_ctes
from ledgerloom.session import kept
from ledgerloom.sources import sinks

TRIM = "regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def _t(x: str) -> str:
    return TRIM.format(x=x)


def _num(x: str) -> str:
    return f"CASE WHEN {x} IS NULL OR {_t(x)} = '' THEN CAST(0 AS DECIMAL(38,10)) ELSE TRY_CAST({_t(x)} AS DECIMAL(38,10)) END"


_DAY = "regexp_matches(payment_date, '^[0-9]{4}-[0-9]{2}-[0-9]{2}$') AND TRY_CAST(payment_date AS DATE) IS NOT NULL"


@register("validate_payments", with_ctes(
    f"""SELECT request_id, TRY_CAST(n_order AS BIGINT) AS order_id, {D('TRY_CAST(n_amount AS DECIMAL(14,2))')} AS amount,
      CASE WHEN {_DAY} THEN TRY_CAST(payment_date AS DATE) END AS payment_date,
      NULLIF({_t('reference_number')}, '') AS reference_number, errors = '' AS is_valid, errors
    FROM (SELECT *, concat_ws(';',
        CASE WHEN n_order IS NULL THEN 'order_id:not a number' END,
        CASE WHEN n_order <> floor(n_order) THEN 'order_id:not an integer' END,
        CASE WHEN n_order IS NOT NULL AND TRY_CAST(n_order AS BIGINT) IS NULL THEN 'order_id:out of range' END,
        CASE WHEN n_order <= 0 THEN 'order_id:must be positive' END,
        CASE WHEN n_amount IS NULL THEN 'amount:not a number' END,
        CASE WHEN COALESCE(CAST(TRY_CAST(n_amount AS DECIMAL(14,2)) AS DECIMAL(38,10)), n_amount) <= 0 THEN 'amount:must be positive' END,
        CASE WHEN n_amount > 999999999999.99 THEN 'amount:above 1e+12' END,
        CASE WHEN NOT COALESCE({_DAY}, FALSE) THEN 'payment_date:invalid date' END,
        CASE WHEN length({_t('reference_number')}) > 120 THEN 'reference_number:longer than 120' END) AS errors
      FROM (SELECT *, {_num('order_id')} AS n_order, {_num('amount')} AS n_amount FROM raw_payments) r0) r"""))
def q_validate_payments(t):
    """V1: row validation of raw payment requests."""
    return Q.validate_payments(t["raw_payments"])


@register("unique_violations", with_ctes(
    """SELECT i.id, i.export_order_id, i.l_linenumber, d.dup_count
    FROM export_order_items i JOIN (SELECT export_order_id, l_linenumber, COUNT(*) AS dup_count
      FROM export_order_items GROUP BY 1, 2 HAVING COUNT(*) > 1) d
      ON d.export_order_id = i.export_order_id AND d.l_linenumber = i.l_linenumber"""))
def q_unique_violations(t):
    """V3: contract lines violating UNIQUE(order, source line number)."""
    i = t["export_order_items"].select("id", "export_order_id", "l_linenumber")
    return Q.unique_violations(i, ["export_order_id", "l_linenumber"]).select(
        "id", "export_order_id", "l_linenumber", "dup_count")


@register("normalize_items", with_ctes(
    f"""SELECT i.id, i.export_order_id, i.product_id, {D('COALESCE(p.units_per_carton, 0)')} AS units_per_carton,
      CASE WHEN p.id IS NULL THEN 'product unavailable' WHEN NOT p.is_active THEN 'product inactive'
        WHEN COALESCE(p.units_per_carton, 0) = 0 THEN 'units per carton not set' END AS line_reason,
      i.export_order_id IN (SELECT i2.export_order_id FROM export_order_items i2 LEFT JOIN products p2
        ON p2.id = i2.product_id WHERE p2.id IS NULL OR NOT p2.is_active OR COALESCE(p2.units_per_carton, 0) = 0)
        AS request_rejected
    FROM export_order_items i LEFT JOIN products p ON p.id = i.product_id"""))
def q_normalize_items(t):
    """V4: item normalisation against the product master; orders rejected whole."""
    i = t["export_order_items"].select("id", "export_order_id", "product_id", "units_per_carton")
    return Q.normalize_items(i, t["products"]).select("id", "export_order_id", "product_id", "units_per_carton",
                                                      "line_reason", "request_rejected")


@register("bank_account_check", with_ctes(
    """SELECT o.id, o.bank_account_id, a.id IS NOT NULL AS bank_account_ok,
      CASE WHEN a.id IS NULL THEN 'select an active bank account' END AS bank_reason
    FROM export_orders o LEFT JOIN (SELECT id FROM bank_accounts WHERE is_active) a ON a.id = o.bank_account_id"""))
def q_bank_account_check(t):
    """V5: orders must carry an active bank account."""
    o = t["export_orders"].select("id", "bank_account_id")
    return Q.check_bank_account(o, t["bank_accounts"])


# The foreign keys checked by the orphan report (label, child, fk, parent, nullable).
FKS = [
    ("orders.client", "export_orders", "client_id", "parties", False),
    ("orders.consignee", "export_orders", "customs_consignee_id", "parties", False),
    ("orders.bank_account", "export_orders", "bank_account_id", "bank_accounts", True),
    ("orders.clearing_agent", "export_orders", "clearing_agent_id", "parties", True),
    ("items.order", "export_order_items", "export_order_id", "export_orders", False),
    ("items.product", "export_order_items", "product_id", "products", False),
    ("payments.order", "order_payments", "export_order_id", "export_orders", False),
    ("payments.user", "order_payments", "created_by", "users", True),
    ("shipments.client", "shipments", "client_id", "parties", False),
    ("shipments.clearing_agent", "shipments", "clearing_agent_id", "parties", True),
    ("containers.shipment", "shipment_containers", "shipment_id", "shipments", False),
    ("allocations.shipment", "shipment_allocations", "shipment_id", "shipments", False),
    ("document_events.user", "document_events", "user_id", "users", False),
    ("document_events.order", "document_events", "target_id", "export_orders", False),
    ("shipments.consignee", "shipments", "customs_consignee_id", "parties", False),
    ("shipments.notify", "shipments", "also_notify_party_id", "parties", True),
    ("allocations.container", "shipment_allocations", "shipment_container_id", "shipment_containers", True),
    ("allocations.legacy_container", "shipment_allocations", "shipment_container_id", "legacy_containers", True),
    ("allocations.item", "shipment_allocations", "export_order_item_id", "export_order_items", False),
    ("users.role", "users", "role_id", "roles", False),
]


def _orphans_sql() -> str:
    parts = []
    for label, child, fk, parent, nullable in FKS:
        cond = f"c.{fk} IS NOT NULL AND " if nullable else ""
        parts.append(f"SELECT '{label}' AS fk_name, CAST(c.id AS BIGINT) AS child_id, CAST(c.{fk} AS BIGINT) AS fk_value "
                     f"FROM {child} c WHERE {cond}NOT EXISTS (SELECT 1 FROM {parent} p WHERE p.id = c.{fk})")
    return "\nUNION ALL\n".join(parts)


@register("orphans", with_ctes(_orphans_sql()), keep=LINES)
def q_orphans(t):
    """Foreign-key orphans across the ledger tables."""
    return Q.all_orphans(t, FKS)


@register("shipment_structure", with_ctes(
    """SELECT request_id, reason, reason IS NULL AS is_valid FROM (
      SELECT COALESCE(c.request_id, a.request_id) AS request_id,
        CASE WHEN c.n_numbers < c.n_containers THEN 'container numbers must be unique'
          WHEN COALESCE(a.unknown_refs, 0) > 0 THEN 'allocation references an unavailable container'
          WHEN COALESCE(a.repeated_pairs, 0) > 0 THEN 'a line may appear once per container'
          WHEN COALESCE(a.used_containers, 0) < COALESCE(c.n_containers, 0) THEN 'every container needs an allocation'
        END AS reason
      FROM (SELECT request_id, COUNT(*) AS n_containers, COUNT(DISTINCT lower(container_number)) AS n_numbers
            FROM request_containers GROUP BY request_id) c
      FULL JOIN (SELECT request_id, COUNT(*) FILTER (WHERE NOT k) AS unknown_refs,
              COUNT(*) FILTER (WHERE n > 1) AS repeated_pairs,
              COUNT(DISTINCT CASE WHEN k THEN container_index END) AS used_containers
            FROM (SELECT r.request_id, r.export_order_item_id, r.container_index, COUNT(*) AS n,
                    bool_or(rc.request_id IS NOT NULL) AS k
                  FROM shipment_requests r LEFT JOIN request_containers rc
                    ON rc.request_id = r.request_id AND rc.container_index = r.container_index
                  GROUP BY 1, 2, 3) pp GROUP BY request_id) a
      ON a.request_id = c.request_id) x"""), keep=LINES)
def q_shipment_structure(t):
    """V6: shipment request structure checks."""
    return Q.check_shipment_structure(t["request_containers"],
                                      t["shipment_requests"].select("request_id", "export_order_item_id",
                                                                    "container_index"))


@register("product_slugs", with_ctes(
    """SELECT id, COALESCE(NULLIF(lower(regexp_replace(regexp_replace(regexp_replace(name, '\\.[^./\\\\]*$', ''),
      '[^A-Za-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')), ''), 'product') AS slug FROM products"""))
def q_product_slugs(t):
    """V8: image-name slugs of product names."""
    return t["products"].select("id", slug(F.col("name")).alias("slug"))


@register("assign_numbers", with_ctes(
    """SELECT d.id, d.sequence_year,
      CAST(COALESCE(m.mx, 0) + row_number() OVER (PARTITION BY d.sequence_year ORDER BY d.id) AS INTEGER) AS sequence_number,
      printf('EXP-%03d/%d', COALESCE(m.mx, 0) + row_number() OVER (PARTITION BY d.sequence_year ORDER BY d.id),
        d.sequence_year) AS invoice_number
    FROM export_orders d LEFT JOIN (SELECT sequence_year, MAX(sequence_number) AS mx FROM export_orders
      WHERE status <> 'draft' GROUP BY sequence_year) m ON m.sequence_year = d.sequence_year
    WHERE d.status = 'draft'"""))
def q_assign_numbers(t):
    """G1: number draft contracts per year after the highest number already issued."""
    o = t["export_orders"]
    new = o.filter(F.col("status") == "draft").select("id", "sequence_year")
    existing = o.filter(F.col("status") != "draft").select("sequence_year", "sequence_number")
    return G.assign_numbers(new, existing, "EXP")


_PAY_STEP = """CASE WHEN {r} <= 0.004 THEN 'fully_paid' WHEN q.amount - {r} > 0.004 THEN 'exceeds' ELSE 'accepted' END,
    CAST(CASE WHEN {r} <= 0.004 OR q.amount - {r} > 0.004 THEN {r}
      ELSE GREATEST(CAST({r} - q.amount AS DECIMAL(30,7)), CAST(0 AS DECIMAL(30,7))) END AS DECIMAL(30,7))"""

ADMIT_SQL = with_ctes(
    f"""SELECT request_id, order_id, {D('amount')} AS amount, outcome, {D('rb')} AS remaining_before,
      {D('ra')} AS remaining_after FROM fold
    UNION ALL
    SELECT q.id, q.export_order_id, {D('q.amount')},
      CASE WHEN q.amount IS NULL OR q.amount <= 0 THEN 'invalid_amount'
        WHEN s.order_id IS NULL THEN 'unknown_order' ELSE 'cancelled' END,
      {D('s.r0')}, {D('s.r0')}
    FROM order_payments q LEFT JOIN pay_start s ON s.order_id = q.export_order_id
    WHERE q.amount IS NULL OR q.amount <= 0 OR s.order_id IS NULL OR s.status = 'cancelled'""", "o_totals", extra={
        "pay_start": """SELECT id AS order_id, status, CAST(GREATEST(CAST(order_total
            - ROUND(order_total * advance_percentage * CAST(0.01 AS DECIMAL(3,2)), 2) AS DECIMAL(30,7)),
            CAST(0 AS DECIMAL(30,7))) AS DECIMAL(30,7)) AS r0 FROM o_totals""",
        "pay_req": """SELECT id AS request_id, export_order_id AS order_id, amount,
            row_number() OVER (PARTITION BY export_order_id ORDER BY id) AS rn FROM order_payments
            WHERE amount > 0""",
        "fold": f"""SELECT q.request_id, q.order_id, q.amount, q.rn, s.r0 AS rb, {_PAY_STEP.format(r='s.r0')}
            FROM pay_req q JOIN pay_start s ON s.order_id = q.order_id WHERE q.rn = 1 AND s.status <> 'cancelled'
            UNION ALL
            SELECT q.request_id, q.order_id, q.amount, q.rn, f.ra, {_PAY_STEP.format(r='f.ra')}
            FROM fold f JOIN pay_req q ON q.order_id = f.order_id AND q.rn = f.rn + 1""",
    }).replace("WITH ", "WITH RECURSIVE ", 1).replace(
        "fold AS (", "fold(request_id, order_id, amount, rn, rb, outcome, ra) AS (", 1)


@register("admit_payments", ADMIT_SQL)
def q_admit_payments(t):
    """The recorded payments replayed as requests in arrival (id) order against fresh balances."""
    req = t["order_payments"].select(F.col("id").alias("request_id"), F.col("export_order_id").alias("order_id"),
                                     "amount")
    return G.admit_payments(t, req, include_existing=False)


# Edits of draft and ready shipments: more of their own lines, a share of the neighbouring shipment's
# lines, then less of their own again.
SHIPMENT_EDITS = """
SELECT s.id * 10 AS request_id, s.id AS shipment_id, s.client_id, a.export_order_item_id,
  CAST(a.quantity * 1.6 AS decimal(12,3)) AS quantity
FROM {shipments} s JOIN {shipment_allocations} a ON a.shipment_id = s.id WHERE s.status IN ('draft', 'ready_to_ship')
UNION ALL
SELECT s.id * 10 + 1, s.id, s.client_id, a.export_order_item_id, CAST(a.quantity * 0.7 AS decimal(12,3))
FROM {shipments} s JOIN {shipment_allocations} a ON a.shipment_id = s.id + 1 AND s.id % 100 < 99
WHERE s.status IN ('draft', 'ready_to_ship')
UNION ALL
SELECT s.id * 10 + 2, s.id, s.client_id, a.export_order_item_id, CAST(a.quantity * 0.5 AS decimal(12,3))
FROM {shipments} s JOIN {shipment_allocations} a ON a.shipment_id = s.id WHERE s.status IN ('draft', 'ready_to_ship')"""


def replay_parts(asked: str) -> dict[str, str]:
    """The requests of ``asked`` (request_id, client_id, ship, line, need) replayed one by one per client.

    The state is what has been taken of each line beyond its start (``used``) and what each shipment
    holds now (``held``); a request sees its own shipment's holding as free."""
    return {
        "asked": asked,
        "start_room": """SELECT i.id AS line, o.client_id AS owner, o.status,
            i.quantity - COALESCE((SELECT SUM(sa.quantity) FROM shipment_allocations sa JOIN shipments s ON s.id = sa.shipment_id
              WHERE sa.export_order_item_id = i.id AND s.status <> 'cancelled'), 0) AS room
            FROM export_order_items i JOIN export_orders o ON o.id = i.export_order_id""",
        "own_lines": """SELECT ship, line, SUM(q) AS own FROM (
              SELECT DISTINCT ship, line, 0 AS q FROM asked WHERE ship IS NOT NULL
              UNION ALL SELECT shipment_id, export_order_item_id, quantity FROM shipment_allocations) GROUP BY ship, line""",
        "wanted": """SELECT r.request_id, r.client_id, r.ship, o.line, COALESCE(n.need, 0) AS need, n.need IS NOT NULL AS is_asked, o.own
            FROM (SELECT DISTINCT request_id, client_id, ship FROM asked WHERE ship IS NOT NULL) r JOIN own_lines o ON o.ship = r.ship
            LEFT JOIN (SELECT request_id, line, SUM(need) AS need FROM asked GROUP BY 1, 2) n ON n.request_id = r.request_id AND n.line = o.line
            UNION ALL
            SELECT request_id, client_id, NULL, line, SUM(need), TRUE, 0 FROM asked WHERE ship IS NULL GROUP BY 1, 2, 4""",
        "turns": """SELECT w.request_id, w.client_id, row_number() OVER (PARTITION BY w.client_id ORDER BY w.request_id) AS turn,
              bool_or(is_asked AND l.line IS NULL) AS missing,
              list({'line': w.line, 'tag': COALESCE(CAST(w.ship AS VARCHAR), 'new') || ':' || CAST(w.line AS VARCHAR), 'need': CAST(w.need AS DECIMAL(22,3)),
                'own': CAST(w.own AS DECIMAL(22,3)), 'room': CAST(l.room AS DECIMAL(22,3)), 'edit': w.ship IS NOT NULL,
                'fault': CASE WHEN NOT w.is_asked THEN NULL WHEN l.owner <> w.client_id THEN 'foreign client' WHEN l.status = 'cancelled' THEN 'cancelled contract' END}
                ORDER BY w.line) AS wants
            FROM wanted w LEFT JOIN start_room l ON l.line = w.line GROUP BY w.request_id, w.client_id""",
        "play": """SELECT client_id, CAST(0 AS BIGINT) AS turn, MAP {CAST(-1 AS BIGINT): CAST(0 AS DECIMAL(22,3))} AS used,
              MAP {'': CAST(0 AS DECIMAL(22,3))} AS held, CAST(NULL AS BIGINT) AS request_id, CAST(NULL AS VARCHAR) AS reason
            FROM (SELECT DISTINCT client_id FROM turns)
            UNION ALL
            SELECT client_id, turn,
              CASE WHEN reason IS NULL THEN map_concat(used, map_from_entries(list_transform(wants, lambda w: {'k': w.line,
                'v': CAST(COALESCE(used[w.line], 0) + w.need - CASE WHEN w.edit THEN COALESCE(held[w.tag], w.own) ELSE 0 END AS DECIMAL(22,3))}))) ELSE used END,
              CASE WHEN reason IS NULL THEN map_concat(held, map_from_entries(list_transform(list_filter(wants, lambda w: w.edit),
                lambda w: {'k': w.tag, 'v': w.need}))) ELSE held END,
              request_id, reason
            FROM (SELECT q.*, p.used, p.held, CASE WHEN q.missing THEN 'missing line' ELSE list_filter(list_transform(q.wants, lambda w:
                CASE WHEN w.fault IS NOT NULL THEN w.fault
                  WHEN w.need > 0 AND w.need > w.room - COALESCE(p.used[w.line], 0) + CASE WHEN w.edit THEN COALESCE(p.held[w.tag], w.own) ELSE 0 END + 0.0001 THEN 'short' END),
                lambda x: x IS NOT NULL)[1] END AS reason
              FROM play p JOIN turns q ON q.client_id = p.client_id AND q.turn = p.turn + 1) step""",
    }


def _replay_sql(asked: str) -> str:
    return with_ctes("SELECT request_id, client_id, CASE WHEN reason IS NULL THEN 'accepted' ELSE 'rejected' END AS outcome, reason "
                     "FROM play WHERE turn > 0", extra=replay_parts(asked)).replace("WITH ", "WITH RECURSIVE ", 1)


@register("admit_shipments", _replay_sql(
    "SELECT request_id, client_id, CAST(NULL AS BIGINT) AS ship, export_order_item_id AS line, quantity AS need FROM shipment_requests"), keep=LINES)
def q_admit_shipments(t):
    """G3 (and A28): allocation requests admitted all-or-nothing in request order."""
    return G.admit_shipments(t, t["shipment_requests"])


@register("shipment_edits", _replay_sql(
    "SELECT request_id, client_id, shipment_id AS ship, export_order_item_id AS line, quantity AS need FROM ("
    + SHIPMENT_EDITS.format(shipments="shipments", shipment_allocations="shipment_allocations") + ") e"), keep=LINES)
def q_shipment_edits(t):
    """I4 admission: edits in request order, each with its own shipment's quantities free for itself."""
    spark = t["shipments"].sparkSession
    edits = spark.sql(SHIPMENT_EDITS, shipments=t["shipments"], shipment_allocations=t["shipment_allocations"])
    return G.admit_shipments(t, edits, edits=edits.select("request_id", "shipment_id").distinct())


_SEQUENCE = "CASE {k} WHEN 0 THEN 'confirmed' WHEN 1 THEN CASE WHEN {i} % 3 = 0 THEN 'cancelled' ELSE 'in_production' END WHEN 2 THEN 'draft' ELSE 'cancelled' END"


@register("order_status_sequence", with_ctes(
    f"""SELECT o.id * 4 + k.k AS request_id, o.id AS order_id, s.status AS requested_status, o.status AS current_status,
      CASE WHEN was = 'cancelled' THEN s.status = 'cancelled' WHEN s.status = 'cancelled' THEN NOT bound ELSE TRUE END AS accepted,
      CASE WHEN was = 'cancelled' THEN 'cancelled' WHEN s.status = 'cancelled' AND bound THEN held ELSE s.status END AS new_status
    FROM (SELECT o.id, o.status,
        EXISTS (SELECT 1 FROM shipment_allocations sa JOIN export_order_items i ON i.id = sa.export_order_item_id
          JOIN shipments sh ON sh.id = sa.shipment_id WHERE i.export_order_id = o.id AND sh.status <> 'cancelled')
        OR EXISTS (SELECT 1 FROM order_payments p WHERE p.export_order_id = o.id) AS bound FROM export_orders o) o
    CROSS JOIN (SELECT unnest([0, 1, 2, 3]) AS k) k
    CROSS JOIN LATERAL (SELECT {_SEQUENCE.format(k='k.k', i='o.id')} AS status) s
    CROSS JOIN LATERAL (SELECT CASE WHEN o.status = 'cancelled' OR (NOT bound AND k.k > 1 AND o.id % 3 = 0) THEN 'cancelled' END AS was,
      CASE WHEN k.k = 0 THEN o.status WHEN k.k = 1 THEN 'confirmed' WHEN o.id % 3 = 0 AND k.k = 2 THEN 'confirmed' WHEN k.k = 2 THEN 'in_production'
        ELSE 'draft' END AS held) w"""), keep=LINES)
def q_order_status_sequence(t):
    """Four requests per order in a row; cancelled is terminal inside the batch."""
    o = t["export_orders"].select(F.col("id").alias("order_id"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k"))
    req = o.select((F.col("order_id") * 4 + F.col("k")).alias("request_id"), "order_id", F.expr(_SEQUENCE.format(k="k", i="order_id")).alias("status"))
    return G.apply_order_status(t, req, f"{AS_OF} 00:00:00").select(
        "request_id", "order_id", "requested_status", "current_status", "accepted", "new_status")


@register("insert_absent", with_ctes(
    """SELECT id, name FROM parties WHERE id % 4 <> 0
    UNION ALL
    SELECT p.id, MIN(concat(p.name, ' ', CAST(k.k AS VARCHAR))) FROM parties p CROSS JOIN (SELECT unnest([1, 2]) AS k) k
    WHERE p.id % 4 = 0 GROUP BY p.id"""))
def q_insert_absent(t):
    """Every party offered twice to a table that lacks a quarter of them; the first offer is inserted."""
    p = t["parties"].select("id", "name")
    offers = p.withColumn("k", F.explode(F.array(F.lit(1), F.lit(2)))).select("id", F.concat("name", F.lit(" "), F.col("k").cast("string")).alias("name"))
    return sinks.insert_absent(p.filter(F.col("id") % 4 != 0), offers, ["id"], order=["name"])


@register("update_orders", with_ctes(
    f"""SELECT id, CASE WHEN id % 3 = 0 AND status <> 'cancelled' THEN 'EUR' ELSE currency END AS currency,
      {D("CASE WHEN id % 3 = 0 AND status <> 'cancelled' THEN 20 ELSE advance_percentage END")} AS advance_percentage
    FROM export_orders"""))
def q_update_orders(t):
    """Two patches for every third order; the later one stands, cancelled orders refuse both."""
    o = t["export_orders"].select("id", "currency", "advance_percentage", "status")
    patch = (o.filter(F.col("id") % 3 == 0).select("id", F.explode(F.array(F.lit(1), F.lit(2))).alias("n"))
             .select("id", "n", F.when(F.col("n") == 1, "GBP").otherwise("EUR").alias("currency"),
                     (F.col("n") * 10).cast("decimal(5,2)").alias("advance_percentage")))
    out, _ = sinks.update_by_key(o, patch, ["id"], ["currency", "advance_percentage"], where=F.col("status") != "cancelled", order=["n"])
    return out.select("id", "currency", "advance_percentage")


@register("replace_children", with_ctes(
    f"""SELECT id, export_order_id, {D('quantity')} AS quantity FROM export_order_items WHERE export_order_id % 5 <> 0
    UNION ALL
    SELECT id + 1000000000000, export_order_id, {D('quantity * 2')} FROM export_order_items WHERE export_order_id % 5 = 0 AND line_number = 1
      AND export_order_id % 10 = 0"""))
def q_replace_children(t):
    """The lines of every fifth order are replaced, half of them by nothing."""
    i = t["export_order_items"].select("id", "export_order_id", "line_number", "quantity")
    new = (i.filter((F.col("export_order_id") % 10 == 0) & (F.col("line_number") == 1))
           .select((F.col("id") + 1000000000000).alias("id"), "export_order_id", "line_number", (F.col("quantity") * 2).cast("decimal(13,3)").alias("quantity")))
    gone = t["export_orders"].filter(F.col("id") % 5 == 0).select("id")
    return sinks.replace_children(i, "export_order_id", new, gone).select("id", "export_order_id", "quantity")


@register("requested_per_line", with_ctes(
    f"SELECT request_id, export_order_item_id, {D('SUM(quantity)')} AS requested FROM shipment_requests GROUP BY 1, 2"))
def q_requested_per_line(t):
    """Requested quantity per request and line, over all containers."""
    return G.requested_per_line(t["shipment_requests"])


@register("revised_totals", with_ctes(
    f"""SELECT export_order_id AS request_id, {D('CAST(SUM(CASE WHEN is_sample OR line_number = 5 THEN 0 WHEN line_number % 3 = 0 THEN 2 * quantity * client_price_per_carton ELSE quantity * client_price_per_carton END) AS DECIMAL(24,7))')} AS revised_total
    FROM export_order_items GROUP BY 1"""))
def q_revised_totals(t):
    """Order totals of proposed item sets: every order's lines, some doubled, fifth lines as samples."""
    n = F.col("line_number")
    proposed = t["export_order_items"].select(
        F.col("export_order_id").alias("request_id"), F.when(n % 3 == 0, F.col("quantity") * 2).otherwise(F.col("quantity")).cast("decimal(12,3)").alias("quantity"),
        "client_price_per_carton", (F.col("is_sample") | (n == 5)).alias("is_sample"))
    return G.revised_totals(proposed)


_STATUS_REQ = "CASE id % 3 WHEN 0 THEN 'cancelled' WHEN 1 THEN 'confirmed' ELSE 'draft' END"


@register("order_status_apply", with_ctes(
    f"""SELECT o.id AS request_id, o.id AS order_id, {_STATUS_REQ.replace('id %', 'o.id %')} AS requested_status,
      o.status AS current_status, reason IS NULL AS accepted, reason,
      CASE WHEN reason IS NULL THEN {_STATUS_REQ.replace('id %', 'o.id %')} ELSE o.status END AS new_status,
      reason IS NULL AND {_STATUS_REQ.replace('id %', 'o.id %')} = 'confirmed' AS confirmed_stamped
    FROM (SELECT o.*, CASE
        WHEN o.status = 'cancelled' AND {_STATUS_REQ.replace('id %', 'o.id %')} <> 'cancelled'
          THEN 'a cancelled order cannot be reopened'
        WHEN {_STATUS_REQ.replace('id %', 'o.id %')} = 'cancelled' AND o.status <> 'cancelled'
          AND COALESCE(a.n, 0) > 0 THEN 'active shipment allocations'
        WHEN {_STATUS_REQ.replace('id %', 'o.id %')} = 'cancelled' AND o.status <> 'cancelled'
          AND COALESCE(p.n, 0) > 0 THEN 'recorded payments' END AS reason
      FROM export_orders o
      LEFT JOIN (SELECT i.export_order_id, COUNT(*) AS n FROM shipment_allocations sa
        JOIN export_order_items i ON i.id = sa.export_order_item_id
        WHERE EXISTS (SELECT 1 FROM shipments s WHERE s.id = sa.shipment_id AND s.status <> 'cancelled')
        GROUP BY 1) a ON a.export_order_id = o.id
      LEFT JOIN (SELECT export_order_id, COUNT(*) AS n FROM order_payments GROUP BY 1) p
        ON p.export_order_id = o.id) o"""), keep=LINES)
def q_order_status_apply(t):
    """One status request per order (cancel / confirm / back to draft)."""
    req = t["export_orders"].select(F.col("id").alias("request_id"), F.col("id").alias("order_id"),
                                    F.expr(_STATUS_REQ).alias("status"))
    out = G.apply_order_status(t, req, f"{AS_OF} 00:00:00")
    return out.select("request_id", "order_id", "requested_status", "current_status", "accepted", "reason",
                      "new_status", (F.col("accepted") & (F.col("requested_status") == "confirmed"))
                      .alias("confirmed_stamped"))


@register("order_eligibility", with_ctes(
    """SELECT o.id AS order_id,
      edit_reason IS NULL AS edit_accepted, edit_reason, delete_reason IS NULL AS delete_accepted, delete_reason
    FROM (SELECT o.id,
        CASE WHEN o.status IN ('shipped', 'completed', 'cancelled')
            THEN 'shipped, completed or cancelled orders cannot be edited'
          WHEN COALESCE(a.n, 0) > 0 THEN 'has shipment allocations'
          WHEN COALESCE(p.n, 0) > 0 AND o.client_id + o.id % 2 <> o.client_id THEN 'client fixed once paid'
          WHEN ROUND(t.order_total * (100 - o.advance_percentage) * CAST(0.01 AS DECIMAL(3,2)), 2)
            + COALESCE(p.r, 0) - t.order_total > 0.004 THEN 'received payments would exceed the total' END AS edit_reason,
        CASE WHEN o.status IN ('shipped', 'completed') THEN 'shipped or completed'
          WHEN COALESCE(a.n, 0) > 0 THEN 'has shipment allocations'
          WHEN COALESCE(p.n, 0) > 0 THEN 'has recorded payments' END AS delete_reason
      FROM export_orders o JOIN o_totals t ON t.id = o.id
      LEFT JOIN (SELECT i.export_order_id, COUNT(*) AS n FROM shipment_allocations sa
        JOIN export_order_items i ON i.id = sa.export_order_item_id GROUP BY 1) a ON a.export_order_id = o.id
      LEFT JOIN (SELECT export_order_id, COUNT(*) AS n, SUM(amount) AS r FROM order_payments GROUP BY 1) p
        ON p.export_order_id = o.id) o""", "o_totals"))
def q_order_eligibility(t):
    """G5 + G6: an edit (odd ids switch client, advance -> 100 - advance, same items) and a delete per order."""
    o = t["export_orders"]
    edits = o.select(F.col("id").alias("request_id"), F.col("id").alias("order_id"),
                     (F.col("client_id") + F.col("id") % 2).alias("client_id"),
                     (F.lit(100) - F.col("advance_percentage")).cast("decimal(5,2)").alias("advance_percentage"))
    e = G.check_order_edits(t, edits).select(F.col("order_id"), F.col("accepted").alias("edit_accepted"),
                                             F.col("reason").alias("edit_reason"))
    d = G.check_order_deletes(t, o.select(F.col("id").alias("order_id"))).select(
        F.col("order_id").alias("_d"), F.col("accepted").alias("delete_accepted"),
        F.col("reason").alias("delete_reason"))
    # each verdict is reached in tasks of its own, not both in one chain of sorted joins
    e, d = kept(e), kept(d)
    return e.join(d, e["order_id"] == d["_d"], "inner").drop("_d")


@register("shipment_changes", with_ctes(
    """SELECT id, status, status IN ('draft', 'ready_to_ship') AS can_edit,
      status NOT IN ('shipped', 'completed', 'cancelled') AS can_edit_gate_pass,
      status NOT IN ('shipped', 'completed') AS can_delete, status <> 'cancelled' AS reopen_accepted
    FROM shipments"""))
def q_shipment_changes(t):
    """G7 + G8: per shipment edit/gate-pass/delete eligibility and a reopen-to-draft request."""
    s = t["shipments"]
    ch = G.check_shipment_changes(s)
    st = G.apply_shipment_status(t, s.select(F.col("id").alias("request_id"), F.col("id").alias("shipment_id"),
                                             F.lit("draft").alias("status")))
    st = st.select(F.col("shipment_id").alias("_sid"), F.col("accepted").alias("reopen_accepted"))
    return ch.join(st, ch["id"] == st["_sid"], "inner").drop("_sid")


@register("account_deletes", with_ctes(
    """SELECT a.id AS account_id, COALESCE(u.n, 0) AS contract_count, COALESCE(u.n, 0) = 0 AS accepted
    FROM bank_accounts a LEFT JOIN (SELECT bank_account_id, COUNT(*) AS n FROM export_orders
      WHERE bank_account_id IS NOT NULL GROUP BY 1) u ON u.bank_account_id = a.id"""))
def q_account_deletes(t):
    """Bank accounts blocked from deletion while contracts use them."""
    return G.check_account_deletes(t, t["bank_accounts"].select(F.col("id").alias("account_id")))


@register("first_container", with_ctes(
    "SELECT shipment_id, MIN(id) AS container_id FROM shipment_containers GROUP BY shipment_id"))
def q_first_container(t):
    """First container per shipment."""
    return G.first_container(t["shipment_containers"])


@register("payment_counts", with_ctes(
    f"""SELECT export_order_id, COUNT(*) AS payment_count, {D('SUM(amount)')} AS additional_received
    FROM order_payments GROUP BY 1"""))
def q_payment_counts(t):
    """Payments per order."""
    return G.payment_counts(t)


@register("max_sequence", with_ctes(
    "SELECT sequence_year AS _year, MAX(sequence_number) AS _max_seq FROM export_orders GROUP BY 1"))
def q_max_sequence(t):
    """Max sequence number per year."""
    return G.max_sequence(t["export_orders"])


_NEW_CONTAINERS = """SELECT s.id * 10 AS id, s.id AS shipment_id, 1 AS line_number,
      concat('CONTAINER-', CAST(s.id AS VARCHAR)) AS container_number, CAST(NULL AS VARCHAR) AS container_type,
      CAST(NULL AS DOUBLE) AS cbm, s.seal_numbers
    FROM shipments s WHERE NOT EXISTS (SELECT 1 FROM legacy_containers c WHERE c.shipment_id = s.id)"""


@register("backfill_containers", with_ctes(_NEW_CONTAINERS))
def q_backfill_containers(t):
    """B1: containers created for shipments that have none (legacy container table)."""
    return B.backfill_containers(t["shipments"], t["legacy_containers"])


@register("backfill_allocation_containers", with_ctes(
    f"""SELECT a.id, a.shipment_id, COALESCE(a.c, f.first_id) AS shipment_container_id
    FROM (SELECT sa.id, sa.shipment_id, lc.id AS c FROM shipment_allocations sa
          LEFT JOIN legacy_containers lc ON lc.id = sa.shipment_container_id) a
    LEFT JOIN (SELECT shipment_id, MIN(id) AS first_id FROM (
        SELECT id, shipment_id FROM legacy_containers UNION ALL SELECT id, shipment_id FROM ({_NEW_CONTAINERS}) n
      ) c GROUP BY shipment_id) f ON f.shipment_id = a.shipment_id"""))
def q_backfill_allocation_containers(t):
    """B1 then B2: legacy allocations whose container is gone point at the shipment's first container."""
    legacy = t["legacy_containers"]
    containers = legacy.unionByName(B.backfill_containers(t["shipments"], legacy), allowMissingColumns=True)
    known = legacy.select(F.col("id").alias("_c"))
    a = t["shipment_allocations"]
    a = (a.join(known, a["shipment_container_id"] == known["_c"], "left")
         .select("id", "shipment_id", F.col("_c").alias("shipment_container_id")))
    return B.backfill_allocation_containers(a, containers)


@register("backfill_packing", with_ctes(
    f"""SELECT id,
      CASE WHEN legacy THEN 'Jar' ELSE package_type END AS package_type,
      {D("CASE WHEN legacy THEN pieces ELSE pieces_per_unit END")} AS pieces_per_unit,
      {D("CASE WHEN legacy THEN packs ELSE units_per_carton END")} AS units_per_carton,
      CASE WHEN legacy THEN concat('{{"pieces_per_pack":',
          regexp_replace(regexp_replace(CAST(CAST(pieces AS DECIMAL(20,6)) AS VARCHAR), '0+$', ''), '\\.$', ''),
          ',"packs_per_carton":',
          regexp_replace(regexp_replace(CAST(CAST(packs AS DECIMAL(20,6)) AS VARCHAR), '0+$', ''), '\\.$', ''), '}}')
        ELSE packaging_details END AS packaging_details
    FROM (SELECT *,
        package_type = 'Carton' AND json_valid(COALESCE(packaging_details, '{{}}')) AS legacy,
        CAST(COALESCE(TRY_CAST(json_extract_string(CASE WHEN json_valid(COALESCE(packaging_details, '{{}}'))
          THEN COALESCE(packaging_details, '{{}}') END, '$.pieces_per_pack') AS DECIMAL(12,3)),
          TRY_CAST(json_extract_string(CASE WHEN json_valid(COALESCE(packaging_details, '{{}}'))
            THEN COALESCE(packaging_details, '{{}}') END, '$.pieces_per_box') AS DECIMAL(12,3)),
          units_per_carton, 0) AS DECIMAL(12,3)) AS pieces,
        CAST(COALESCE(TRY_CAST(json_extract_string(CASE WHEN json_valid(COALESCE(packaging_details, '{{}}'))
            THEN COALESCE(packaging_details, '{{}}') END, '$.packs_per_carton') AS DECIMAL(12,3)),
          TRY_CAST(json_extract_string(CASE WHEN json_valid(COALESCE(packaging_details, '{{}}'))
            THEN COALESCE(packaging_details, '{{}}') END, '$.jars_per_carton') AS DECIMAL(12,3)),
          pieces_per_unit, 0) AS DECIMAL(12,3)) AS packs
      FROM products) p"""))
def q_backfill_packing(t):
    """Legacy Carton packing migrated to Jar; rows whose packaging text is not JSON stay as they are."""
    p = t["products"]
    return B.backfill_packing(p).select("id", "package_type", "pieces_per_unit", "units_per_carton",
                                        "packaging_details")


@register("backfill_bank_account", with_ctes(
    "SELECT id, COALESCE(bank_account_id, 1) AS bank_account_id FROM export_orders"))
def q_backfill_bank_account(t):
    """Default bank account (id 1) for contracts without one."""
    return B.backfill_bank_account(t["export_orders"].select("id", "bank_account_id"), 1)


_UPSERT_SRC = """SELECT id, upper(name) AS name, TRUE AS is_active, party_type, country FROM parties
    WHERE party_type = 'client' AND id % 3 = 0
    UNION ALL
    SELECT id + 3000000000, concat('New ', name), TRUE, party_type, country FROM parties
    WHERE party_type = 'client' AND id % 50 = 0"""


@register("upsert_parties", with_ctes(
    f"""SELECT COALESCE(t.id, s.id) AS id,
      CASE WHEN s.id IS NOT NULL THEN s.name ELSE t.name END AS name,
      CASE WHEN t.id IS NULL THEN s.party_type ELSE t.party_type END AS party_type,
      CASE WHEN t.id IS NULL THEN s.country ELSE t.country END AS country,
      CASE WHEN s.id IS NOT NULL THEN s.is_active ELSE t.is_active END AS is_active
    FROM (SELECT id, name, party_type, country, is_active FROM parties) t
    FULL JOIN ({_UPSERT_SRC}) s ON s.id = t.id"""))
def q_upsert_parties(t):
    """Upsert of renamed/reactivated clients plus new ones (name, is_active updated on match)."""
    p = t["parties"]
    target = p.select("id", "name", "party_type", "country", "is_active")
    clients = p.filter(F.col("party_type") == "client")
    src = (clients.filter(F.col("id") % 3 == 0)
           .select("id", F.upper("name").alias("name"), F.lit(True).alias("is_active"), "party_type", "country")
           .unionByName(clients.filter(F.col("id") % 50 == 0)
                        .select((F.col("id") + 3000000000).alias("id"), F.concat(F.lit("New "), F.col("name")).alias("name"),
                                F.lit(True).alias("is_active"), "party_type", "country")))
    return sinks.upsert(target, src, ["id"], ["name", "is_active"])


@register("soft_delete", with_ctes(
    "SELECT id, CASE WHEN id % 7 = 0 THEN FALSE ELSE is_active END AS is_active FROM products"))
def q_soft_delete(t):
    """Soft delete of every seventh product."""
    p = t["products"].select("id", "is_active")
    return sinks.soft_delete(p, p.filter(F.col("id") % 7 == 0).select("id"))


@register("cascade_delete", with_ctes(
    """SELECT id, export_order_id FROM export_order_items i
    WHERE NOT EXISTS (SELECT 1 FROM export_orders o WHERE o.id = i.export_order_id AND o.status = 'draft')"""))
def q_cascade_delete(t):
    """Deleting draft contracts removes their lines (remaining lines returned)."""
    tables = {"export_orders": t["export_orders"], "export_order_items": t["export_order_items"]}
    ids = t["export_orders"].filter(F.col("status") == "draft").select("id")
    out = sinks.cascade_delete(tables, "export_orders", ids)
    return out["export_order_items"].select("id", "export_order_id")


@register("cascade_delete_shipments", with_ctes(
    """SELECT 'shipments' AS source, id, id AS shipment_id FROM shipments WHERE id % 3 <> 0
    UNION ALL SELECT 'containers', id, shipment_id FROM shipment_containers WHERE shipment_id % 3 <> 0
    UNION ALL SELECT 'allocations', id, shipment_id FROM shipment_allocations WHERE shipment_id % 3 <> 0
    UNION ALL SELECT 'audit', id, target_id FROM document_events WHERE NOT on_order AND NOT (target_id % 3 = 0 AND target_id IN (SELECT id FROM shipments))"""))
def q_cascade_delete_shipments(t):
    """Every third shipment deleted with its containers, allocations and audit rows (what is left of each)."""
    audit = t["document_events"].filter("not on_order").select("id", F.col("target_id").alias("shipment_id"), "user_id", "action_name")
    tables = {n: t[n] for n in ("shipments", "shipment_containers", "shipment_allocations")} | {"shipment_document_audit_logs": audit}
    out = sinks.cascade_delete(tables, "shipments", t["shipments"].filter(F.col("id") % 3 == 0).select("id"))
    parts = {"shipments": out["shipments"].select("id", F.col("id").alias("shipment_id")), "containers": out["shipment_containers"],
             "allocations": out["shipment_allocations"], "audit": out["shipment_document_audit_logs"]}
    rows = [df.select(F.lit(name).alias("source"), "id", "shipment_id") for name, df in parts.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])
