"""SQL for the registered queries, over the same parquet tables."""

from __future__ import annotations

# The retail views of stockline/sources/star.py in SQL.
_VIEWS = {
    "products": """
        SELECT p_partkey AS id, 'BRG-' || lpad(CAST(p_partkey AS VARCHAR), greatest(6, length(CAST(p_partkey AS VARCHAR)))::INT, '0') AS code, p_name AS name,
            CAST(CASE p_type WHEN 'ECONOMY' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'SMALL' THEN 3
                 WHEN 'STANDARD' THEN 4 WHEN 'LARGE' THEN 5 END AS BIGINT) AS category_id,
            p_brand AS unit,
            CASE WHEN p_size <> 49 THEN CAST(round(p_retailprice * 80) AS BIGINT) END AS purchase_price,
            CAST(round(p_retailprice * 100) AS BIGINT) AS sale_price,
            CASE WHEN p_size <> 48 THEN CAST(p_size - 3 AS BIGINT) END AS stock,
            CAST(DATE '1995-01-01' + p_size AS DATE) AS entry_date,
            'Rak ' || p_brand AS storage_location,
            CASE WHEN p_size <> 50 THEN p_partkey % 10 END AS supplier_id
        FROM part""",
    "categories": """
        SELECT CAST(r_regionkey + 1 AS BIGINT) AS id, r_name AS name, 'Kategori ' || r_name AS description FROM region""",
    "suppliers": """
        SELECT s_suppkey AS id, s_name AS name, 'Jl. ' || CAST(s_nationkey AS VARCHAR) AS address,
            '08' || lpad(CAST(s_suppkey AS VARCHAR), greatest(8, length(CAST(s_suppkey AS VARCHAR)))::INT, '0') AS phone,
            CASE WHEN s_acctbal >= 0 THEN 's' || CAST(s_suppkey AS VARCHAR) || '@example.com' END AS email
        FROM supplier""",
    "customers": """
        SELECT c_custkey AS id, c_name AS name, '08' || lpad(CAST(c_custkey AS VARCHAR), greatest(8, length(CAST(c_custkey AS VARCHAR)))::INT, '0') AS phone,
            'c' || CAST(c_custkey AS VARCHAR) || '@example.com' AS email, c_mktsegment AS address,
            CAST(floor(c_acctbal) AS BIGINT) AS points
        FROM customer""",
    "users": """
        SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS username,
            CASE n_nationkey % 3 WHEN 0 THEN 'admin' WHEN 1 THEN 'kasir' ELSE 'gudang' END AS role
        FROM nation""",
    "lines": """
        SELECT *,
            price * quantity AS total_price, price AS sale_price, price - purchase_price AS profit_per_unit
        FROM (
            SELECT *, CASE WHEN line_number <> 7 THEN CAST(floor(price * 0.8) AS BIGINT) END AS purchase_price
            FROM (
                SELECT ((l_orderkey * 8 + l_linenumber) * 1000 + l_partkey % 1000) * 1000 + l_suppkey % 1000 AS id,
                    l_orderkey AS receipt_id, l_linenumber AS line_number, l_returnflag AS flag,
                    CASE WHEN l_linenumber = 7 AND l_returnflag = 'N' THEN l_partkey + 100000000000
                         WHEN l_linenumber = 7 AND l_returnflag = 'A' THEN NULL
                         ELSE l_partkey END AS product_id,
                    CAST(l_quantity AS BIGINT) AS quantity, l_quantity AS raw_quantity, l_suppkey AS supplier_key,
                    CAST(floor(l_extendedprice * 100 / l_quantity) AS BIGINT) AS price,
                    CAST(l_shipdate AS DATE) AS ship_date, l_linestatus AS line_status
                FROM lineitem) AS a) AS b""",
    "order_heads": """
        SELECT o_orderkey AS receipt_id, CAST(o_orderdate AS DATE) AS date,
            'Kasir ' || CAST(o_custkey % 5 AS VARCHAR) AS cashier_name,
            CASE o_orderpriority WHEN '1-URGENT' THEN 'Tunai' WHEN '2-HIGH' THEN 'QRIS' WHEN '3-MEDIUM' THEN 'Transfer'
                 WHEN '4-NOT SPECIFIED' THEN 'Debit' ELSE 'Kredit' END AS payment_method
        FROM orders""",
    "sales": """
        SELECT l.*, h.date, h.cashier_name, h.payment_method FROM lines AS l JOIN order_heads AS h USING (receipt_id)""",
    "receipts": """
        SELECT receipt_id AS id, MIN(date) AS date, MIN(cashier_name) AS cashier_name,
            MIN(payment_method) AS payment_method, CAST(SUM(total_price) AS BIGINT) AS subtotal,
            CAST(SUM(quantity) AS BIGINT) AS total_items
        FROM sales GROUP BY receipt_id""",
    "incoming": """
        SELECT id, ship_date AS date_in, product_id, quantity, supplier_key AS supplier_id,
            'Staf ' || CAST(supplier_key % 3 AS VARCHAR) AS staff_name
        FROM lines""",
    "logs": """
        SELECT event_id AS id,
            CASE event_type WHEN 'purchase' THEN 'sell' WHEN 'view' THEN 'incoming' WHEN 'click' THEN 'stock_opname'
                 WHEN 'signup' THEN 'create' ELSE 'delete' END AS type,
            CASE WHEN event_type <> 'signup' THEN user_id END AS product_id,
            CASE event_type WHEN 'error' THEN 0 WHEN 'click' THEN CAST(floor(value) AS BIGINT) - 20
                 ELSE CAST(floor(value) AS BIGINT) END AS quantity,
            props AS note, ts AS created_at
        FROM events""",
    "catalog": """
        SELECT p.*, c.name AS category_name, s.name AS supplier_name
        FROM products AS p LEFT JOIN categories AS c ON c.id = p.category_id
            LEFT JOIN suppliers AS s ON s.id = p.supplier_id""",
    # ---- request batches ----
    "cart_lines": """
        SELECT receipt_id AS cart_id, id AS line, product_id,
            CASE WHEN line_number = 7 AND flag = 'R' THEN CAST(quantity AS VARCHAR) || 'd'
                 WHEN line_number = 6 THEN '  ' || CAST(quantity AS VARCHAR) || '.0 '
                 WHEN line_number = 5 THEN CAST(quantity AS VARCHAR) || 'e0'
                 ELSE CAST(quantity AS VARCHAR) END AS quantity_text
        FROM lines""",
    "cart_numbers": """
        SELECT cart_id, line, product_id, quantity_text,
            CASE WHEN regexp_full_match(trim(quantity_text), '[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?')
                 THEN CAST(CAST(trim(quantity_text) AS DOUBLE) AS BIGINT) ELSE 0 END AS quantity
        FROM cart_lines""",
    "priced": """
        SELECT x.*, p.code AS product_code, p.name AS product_name, p.unit, p.stock_now, p.price,
            p.cost AS purchase_price, p.price - p.cost AS profit_per_unit, p.price * x.quantity AS total_price,
            CASE WHEN coalesce(x.product_id, 0) = 0 OR x.quantity <= 0 THEN 'bad_item'
                 WHEN p.id IS NULL THEN 'unknown_product' END AS early_reason
        FROM cart_numbers AS x LEFT JOIN (
            SELECT id, code, name, unit, coalesce(stock, 0) AS stock_now, coalesce(sale_price, 0) AS price,
                coalesce(purchase_price, 0) AS cost FROM products) AS p ON p.id = x.product_id""",
    "snapshot_lines": """
        SELECT *, coalesce(early_reason, CASE WHEN stock_now < quantity THEN 'not_enough_stock' END) AS reason
        FROM priced""",
    "cumulative_lines": """
        SELECT *, coalesce(early_reason, CASE WHEN stock_left < quantity THEN 'not_enough_stock' END) AS reason
        FROM (
            SELECT *, CAST(stock_now - (SUM(greatest(quantity, 0)) OVER (
                    PARTITION BY cart_id, product_id ORDER BY line, quantity
                    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - greatest(quantity, 0)) AS BIGINT) AS stock_left
            FROM priced) AS r""",
}


def _verdicts(lines: str) -> str:
    """Cart verdicts over checked lines."""
    return f"""
        SELECT cart_id, payment_method, cashier_name, reason IS NULL AS accepted, reason,
            CASE WHEN reason IS NULL THEN subtotal END AS subtotal,
            CASE WHEN reason IS NULL THEN total_items END AS total_items,
            CASE WHEN reason IS NULL THEN cost END AS cost,
            CASE WHEN reason IS NULL THEN profit END AS profit
        FROM (
            SELECT h.receipt_id AS cart_id, h.payment_method, h.cashier_name,
                CASE WHEN j.cart_id IS NULL THEN 'empty_cart' ELSE f.reason END AS reason,
                j.subtotal, j.total_items, j.cost, j.profit
            FROM order_heads AS h
            LEFT JOIN (
                SELECT cart_id, CAST(SUM(total_price) AS BIGINT) AS subtotal, CAST(SUM(quantity) AS BIGINT) AS total_items,
                    CAST(SUM(purchase_price * quantity) AS BIGINT) AS cost,
                    CAST(SUM(profit_per_unit * quantity) AS BIGINT) AS profit
                FROM {lines} GROUP BY cart_id) AS j ON j.cart_id = h.receipt_id
            LEFT JOIN (
                SELECT cart_id, reason FROM (
                    SELECT cart_id, reason, row_number() OVER (PARTITION BY cart_id ORDER BY line, reason) AS rn
                    FROM {lines} WHERE reason IS NOT NULL) AS n WHERE rn = 1) AS f ON f.cart_id = h.receipt_id
        ) AS v"""


_VIEWS["snapshot_verdicts"] = _verdicts("snapshot_lines")
_VIEWS["cumulative_verdicts"] = _verdicts("cumulative_lines")
_VIEWS["snapshot_receipts"] = """
        SELECT row_number() OVER (ORDER BY cart_id) + 1000 AS id, DATE '2001-08-01' AS date, cashier_name,
            payment_method, subtotal, total_items, cart_id
        FROM snapshot_verdicts WHERE accepted"""
_VIEWS["snapshot_sold"] = """
        SELECT l.*, r.id AS receipt_id, r.date, r.cashier_name, r.payment_method
        FROM snapshot_lines AS l JOIN snapshot_receipts AS r USING (cart_id)"""
_VIEWS["cumulative_receipts"] = _VIEWS["snapshot_receipts"].replace("snapshot", "cumulative")
_VIEWS["cumulative_sold"] = _VIEWS["snapshot_sold"].replace("snapshot", "cumulative")
_VIEWS["sums_by_product"] = """
        SELECT product_id, CAST(SUM(quantity) AS BIGINT) AS total_qty, CAST(SUM(total_price) AS BIGINT) AS total_revenue,
            CAST(SUM(coalesce(purchase_price, 0) * quantity) AS BIGINT) AS total_capital,
            CAST(SUM(profit_per_unit * quantity) AS BIGINT) AS total_profit
        FROM sales GROUP BY product_id"""
_VIEWS["sums_1998"] = _VIEWS["sums_by_product"].replace(
    "FROM sales", "FROM sales WHERE date BETWEEN DATE '1998-01-01' AND DATE '1998-12-31'"
)
_VIEWS["trend"] = """
        SELECT date AS day, CAST(SUM(total_price) AS BIGINT) AS total_gross,
            CAST(SUM(coalesce(purchase_price, 0) * quantity) AS BIGINT) AS total_capital,
            CAST(SUM(coalesce(profit_per_unit, 0) * quantity) AS BIGINT) AS total_net
        FROM sales GROUP BY date ORDER BY day DESC LIMIT 7"""
_VIEWS["last_week"] = """
        SELECT CAST(d AS DATE) AS day
        FROM (SELECT unnest(generate_series((SELECT MAX(date) FROM sales) - INTERVAL 6 DAY,
                                            (SELECT MAX(date) FROM sales), INTERVAL 1 DAY)) AS d) AS g"""
_VIEWS["filled"] = """
        SELECT w.day,
            CASE dayofweek(w.day) WHEN 0 THEN 'Min' WHEN 1 THEN 'Sen' WHEN 2 THEN 'Sel' WHEN 3 THEN 'Rab'
                 WHEN 4 THEN 'Kam' WHEN 5 THEN 'Jum' ELSE 'Sab' END || ', ' || strftime(w.day, '%d') || ' ' ||
            CASE month(w.day) WHEN 1 THEN 'Jan' WHEN 2 THEN 'Feb' WHEN 3 THEN 'Mar' WHEN 4 THEN 'Apr' WHEN 5 THEN 'Mei'
                 WHEN 6 THEN 'Jun' WHEN 7 THEN 'Jul' WHEN 8 THEN 'Agu' WHEN 9 THEN 'Sep' WHEN 10 THEN 'Okt'
                 WHEN 11 THEN 'Nov' ELSE 'Des' END AS label,
            coalesce(t.total_gross, 0) AS total_gross, coalesce(t.total_capital, 0) AS total_capital,
            coalesce(t.total_net, 0) AS total_net
        FROM last_week AS w LEFT JOIN trend AS t ON t.day = w.day"""
_VIEWS["today"] = """
        SELECT CAST(coalesce(SUM(total_price), 0) AS BIGINT) AS "todaySales",
            CAST(coalesce(SUM(total_price), 0) AS BIGINT) AS "todayGrossRevenue",
            CAST(coalesce(SUM(purchase_price * quantity), 0) AS BIGINT) AS "todayCapitalCost",
            CAST(coalesce(SUM(profit_per_unit * quantity), 0) AS BIGINT) AS "todayNetProfit"
        FROM sales WHERE date = (SELECT MAX(date) FROM sales)"""
_VIEWS["figures"] = """
        SELECT 'totalProducts' AS figure, (SELECT COUNT(*) FROM products) AS amount
        UNION ALL SELECT 'totalUsers', (SELECT COUNT(*) FROM users)
        UNION ALL SELECT 'totalCustomers', (SELECT COUNT(*) FROM customers)
        UNION ALL SELECT 'totalSuppliers', (SELECT COUNT(*) FROM suppliers)
        UNION ALL SELECT 'lowStock', (SELECT COUNT(*) FROM products WHERE coalesce(stock, 0) <= 5)
        UNION ALL SELECT 'todaySales', (SELECT "todaySales" FROM today)
        UNION ALL SELECT 'todayGrossRevenue', (SELECT "todayGrossRevenue" FROM today)"""
_VIEWS["counted"] = """
        SELECT l.receipt_id AS session_id, l.id AS line, l.product_id, p.system_stock,
            CASE WHEN l.line_number = 6 THEN 0 ELSE l.quantity END AS counted_stock,
            CASE WHEN l.line_number = 6 THEN 0 ELSE l.quantity END - p.system_stock AS difference,
            l.flag AS note, p.id IS NOT NULL AS found
        FROM lines AS l LEFT JOIN (SELECT id, coalesce(stock, 0) AS system_stock FROM products) AS p
            ON p.id = l.product_id"""
_VIEWS["count_heads"] = """
        SELECT o_orderkey AS session_id, o_orderdate AS counted_at,
            CASE WHEN o_orderstatus <> 'P' THEN 'Staf ' || CAST(o_custkey % 3 AS VARCHAR) ELSE 'Gudang' END AS staff_name,
            CAST(NULL AS VARCHAR) AS note
        FROM orders"""
_VIEWS["count_reasons"] = """
        SELECT h.*, CASE WHEN f.session_id IS NULL THEN 'empty_count' WHEN NOT f.all_found THEN 'unknown_product' END
            AS reject_reason
        FROM count_heads AS h LEFT JOIN (
            SELECT session_id, bool_and(found) AS all_found FROM counted GROUP BY session_id) AS f USING (session_id)"""
_VIEWS["count_kept"] = """
        SELECT c.*, r.staff_name FROM counted AS c JOIN count_reasons AS r USING (session_id)
        WHERE r.reject_reason IS NULL"""
_VIEWS["incoming_requests"] = """
        SELECT id AS seq, product_id, CASE WHEN line_number = 7 THEN 0 ELSE quantity END AS quantity,
            CASE WHEN supplier_key <> 0 THEN supplier_key END AS supplier_id,
            CASE flag WHEN 'A' THEN 'Staf ' || CAST(supplier_key AS VARCHAR) WHEN 'R' THEN 'Gudang'
                 ELSE 'Kasir ' || CAST(supplier_key AS VARCHAR) END AS staff_name
        FROM lines"""
_VIEWS["incoming_judged"] = """
        SELECT i.*, CASE WHEN coalesce(i.product_id, 0) = 0 OR i.quantity <= 0 THEN 'bad_incoming'
                         WHEN p.id IS NULL THEN 'unknown_product' END AS reject_reason
        FROM incoming_requests AS i LEFT JOIN products AS p ON p.id = i.product_id"""
_VIEWS["offers"] = """
        SELECT p_partkey * 2 + copy AS seq,
            CASE WHEN p_size < 10 THEN 'BRG-' ELSE 'NEW-' END || lpad(CAST(p_partkey AS VARCHAR), greatest(6, length(CAST(p_partkey AS VARCHAR)))::INT, '0') AS code,
            CASE WHEN p_brand = 'Brand#1' THEN '' ELSE p_name END AS name,
            CAST(CASE p_type WHEN 'ECONOMY' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'SMALL' THEN 3
                 WHEN 'STANDARD' THEN 4 WHEN 'LARGE' THEN 5 END AS BIGINT) AS category_id,
            p_brand AS unit, CAST(floor(p_retailprice) AS BIGINT) AS purchase_price,
            CAST(floor(p_retailprice) AS BIGINT) * 100 AS sale_price,
            CAST(CASE WHEN copy = 0 THEN p_size ELSE 0 END AS BIGINT) AS stock, p_size <> 7 AS whole
        FROM part, (VALUES (0), (1)) AS c(copy)"""
_VIEWS["offers_judged"] = """
        SELECT *, CASE WHEN NOT complete THEN 'invalid_data'
                       WHEN known OR row_number() OVER (PARTITION BY complete, known, code ORDER BY seq) > 1
                       THEN 'duplicate_code' END AS reject_reason
        FROM (SELECT o.*, o.whole AND o.code <> '' AND o.name <> '' AND o.unit <> '' AND coalesce(o.category_id, 0) <> 0 AS complete,
                  p.id IS NOT NULL AS known
              FROM offers AS o LEFT JOIN products AS p ON p.code = o.code) AS j"""
_VIEWS["created"] = """
        SELECT (SELECT MAX(id) FROM products) + row_number() OVER (ORDER BY seq) AS id, * FROM offers_judged
        WHERE reject_reason IS NULL"""
_VIEWS["last_changes"] = """
        SELECT * FROM (
            SELECT product_id AS id, line_number, price, quantity, supplier_key,
                row_number() OVER (PARTITION BY product_id ORDER BY id DESC) AS rn
            FROM lines WHERE line_number <> 6) AS n WHERE rn = 1"""
_VIEWS["scans"] = """
        SELECT line AS scan, CASE WHEN quantity_text = '13' THEN '  '
            ELSE ' brg-' || lpad(CAST(product_id AS VARCHAR), greatest(6, length(CAST(product_id AS VARCHAR)))::INT, '0')
            END AS code
        FROM cart_lines"""
_VIEWS["requests"] = """
        SELECT line AS seq, product_id, quantity, price, total_price, stock_now, early_reason,
            CASE WHEN early_reason IS NULL
                 THEN row_number() OVER (PARTITION BY product_id, early_reason ORDER BY line, quantity) END AS nth
        FROM priced"""

_VIEWS["log_requests"] = """
        SELECT *, CASE WHEN early_reason IS NULL
                       THEN row_number() OVER (PARTITION BY product_id, early_reason ORDER BY seq) END AS nth
        FROM (
            SELECT g.id AS seq, g.product_id, g.quantity, p.price, p.price * g.quantity AS total_price, p.stock_now,
                CASE WHEN coalesce(g.product_id, 0) = 0 OR g.quantity <= 0 THEN 'bad_item'
                     WHEN p.id IS NULL THEN 'unknown_product' END AS early_reason
            FROM logs AS g LEFT JOIN (
                SELECT id, coalesce(stock, 0) AS stock_now, coalesce(sale_price, 0) AS price FROM products) AS p
                ON p.id = g.product_id) AS j"""


def _with_views(sql: str, recursive: str = "") -> str:
    """The statement after the views it needs, in order."""
    needed: set[str] = set()

    def need(text: str) -> None:
        for name, body in _VIEWS.items():
            if name not in needed and _mentions(text, name):
                needed.add(name)
                need(body)

    need(sql + recursive)
    parts = [f"{name} AS ({body})" for name, body in _VIEWS.items() if name in needed]
    if recursive:
        parts.append(recursive)
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(parts) + "\n" + sql


def _mentions(text: str, name: str) -> bool:
    words = text.replace("(", " ").replace(")", " ").replace(",", " ").split()
    return any(before.upper() in ("FROM", "JOIN") and word == name for before, word in zip(words, words[1:]))


_KEPT = {
    # ---- catalogue ----
    "catalog_view": """SELECT *, category_id AS "categoryId", category_name AS category, supplier_id AS "supplierId",
        supplier_name AS supplier FROM catalog""",
    "search_products": """SELECT id, code, name FROM products
        WHERE contains(lower(name), 'anvil') OR contains(lower(coalesce(code, '')), 'anvil')""",
    "filter_catalog": "SELECT id, code, name, category_id, supplier_id FROM products WHERE category_id = 3 AND supplier_id = 4",
    "lookup_code": """SELECT s.scan, s.code, p.id AS product_id, p.name AS product_name
        FROM scans AS s LEFT JOIN products AS p ON lower(p.code) = trim(s.code)""",
    "missed_codes": """SELECT s.scan, s.code FROM scans AS s
        WHERE coalesce(trim(s.code), '') NOT IN (SELECT lower(code) FROM products)""",
    "low_stock": """SELECT *, name || ' — ' || CAST(coalesce(stock, 0) AS VARCHAR) || ' tersisa' AS shown
        FROM catalog WHERE coalesce(stock, 0) <= 5""",
    "stock_tier": """SELECT id, stock,
        CASE WHEN coalesce(stock, 0) <= 0 THEN 'Habis' WHEN stock <= 5 THEN 'Akan habis' ELSE 'Aman' END AS tier,
        CASE WHEN coalesce(stock, 0) <= 5 THEN 'Stok rendah' ELSE 'Stok aman' END AS badge FROM products""",
    "stock_board": """SELECT id, code, name, coalesce(category_name, '—') AS category, coalesce(supplier_name, '—') AS supplier,
        sale_price, coalesce(stock, 0) AS stock,
        CASE WHEN coalesce(stock, 0) <= 0 THEN 'Habis' WHEN stock <= 5 THEN 'Akan habis' ELSE 'Aman' END AS tier,
        CASE WHEN coalesce(stock, 0) <= 0 THEN 2 WHEN stock <= 5 THEN 1 ELSE 0 END AS tier_rank
        FROM catalog ORDER BY tier_rank, id DESC""",
    "price_list": "SELECT code, name, stock, purchase_price, sale_price FROM products ORDER BY name NULLS FIRST, code NULLS FIRST",
    "preferred_supplier": """SELECT p.id AS product_id, s.id AS supplier_id, s.name AS supplier_name
        FROM products AS p JOIN suppliers AS s ON s.id = p.supplier_id""",
    "product_margin": """SELECT id, code, name, purchase_price, sale_price,
        coalesce(sale_price, 0) - coalesce(purchase_price, 0) AS margin FROM products""",
    "product_options": """SELECT id, code || ' — ' || name || ' (Stok: ' || CAST(coalesce(stock, 0) AS VARCHAR) || ')' AS label
        FROM products""",
    "list_desc": "SELECT * FROM customers ORDER BY id DESC",
    "duplicate_keys": "SELECT name, COUNT(*) AS copies FROM products WHERE name IS NOT NULL GROUP BY name HAVING COUNT(*) > 1",
    # ---- figures and trends ----
    "entity_counts": """SELECT (SELECT COUNT(*) FROM products) AS "totalProducts", (SELECT COUNT(*) FROM users) AS "totalUsers",
        (SELECT COUNT(*) FROM customers) AS "totalCustomers" """,
    "daily_kpis": "SELECT * FROM today",
    "daily_kpis_receipts": """SELECT CAST(coalesce((SELECT SUM(subtotal) FROM receipts WHERE date = d), 0) AS BIGINT) AS "todaySales",
            CAST(coalesce((SELECT SUM(subtotal) FROM receipts WHERE date = d), 0) AS BIGINT) AS "todayGrossRevenue",
            CAST(coalesce((SELECT SUM(purchase_price * quantity) FROM sales WHERE date = d), 0) AS BIGINT) AS "todayCapitalCost",
            CAST(coalesce((SELECT SUM(profit_per_unit * quantity) FROM sales WHERE date = d), 0) AS BIGINT) AS "todayNetProfit"
        FROM (SELECT MAX(date) AS d FROM receipts) AS m""",
    "sales_trend": "SELECT * FROM trend",
    "sales_trend_filled": "SELECT * FROM filled",
    "trend_bounds": """SELECT lo AS min_value, hi AS max_value, CAST(lo + (hi - lo) / 2.0 AS DOUBLE) AS mid_value FROM (
        SELECT least(MIN(total_gross), MIN(total_capital), MIN(total_net), 0) AS lo,
            greatest(MAX(total_gross), MAX(total_capital), MAX(total_net), 1) AS hi FROM filled) AS b""",
    "receipt_trend": """SELECT h.date AS day, CAST(h.gross AS BIGINT) AS total_gross, CAST(i.capital AS BIGINT) AS total_capital,
            CAST(i.net AS BIGINT) AS total_net
        FROM (SELECT date, SUM(subtotal) AS gross FROM receipts GROUP BY date) AS h
        JOIN (SELECT date, SUM(purchase_price * quantity) AS capital, SUM(profit_per_unit * quantity) AS net
              FROM sales GROUP BY date) AS i ON i.date = h.date
        ORDER BY day DESC LIMIT 7""",
    "incoming_trend": """SELECT date_in AS day, CAST(SUM(quantity) AS BIGINT) AS total FROM incoming
        GROUP BY date_in ORDER BY day DESC LIMIT 7""",
    "period_finance": """SELECT CAST(coalesce(SUM(total_price), 0) AS BIGINT) AS "periodGross",
            CAST(coalesce(SUM(profit_per_unit * quantity), 0) AS BIGINT) AS "periodNet",
            CAST(coalesce(SUM(coalesce(purchase_price, 0) * quantity), 0) AS BIGINT) AS "periodCapital",
            COUNT(*) AS "totalTransactions"
        FROM sales""",
    "period_finance_1998": """SELECT CAST(coalesce(SUM(total_price), 0) AS BIGINT) AS "periodGross",
            CAST(coalesce(SUM(profit_per_unit * quantity), 0) AS BIGINT) AS "periodNet",
            CAST(coalesce(SUM(coalesce(purchase_price, 0) * quantity), 0) AS BIGINT) AS "periodCapital",
            COUNT(*) AS "totalTransactions"
        FROM sales WHERE date BETWEEN DATE '1998-01-01' AND DATE '1998-12-31'""",
    "date_preset": """SELECT DISTINCT date AS day, date AS today_start, date AS today_end,
            CAST(date_trunc('week', date) AS DATE) AS "thisWeek_start",
            CAST(date_trunc('week', date) + INTERVAL 6 DAY AS DATE) AS "thisWeek_end",
            CAST(date_trunc('month', date) AS DATE) AS "thisMonth_start",
            CAST(last_day(date) AS DATE) AS "thisMonth_end",
            CAST(date_trunc('month', date) - INTERVAL 1 MONTH AS DATE) AS "lastMonth_start",
            CAST(date_trunc('month', date) - INTERVAL 1 DAY AS DATE) AS "lastMonth_end",
            CAST(NULL AS DATE) AS "allTime_start", CAST(NULL AS DATE) AS "allTime_end"
        FROM sales""",
    "role_dashboard": """SELECT l.role, CAST(l.position AS INTEGER) AS position, l.label,
            CASE WHEN l.money THEN CASE WHEN f.amount < 0 THEN '-' ELSE '' END || 'Rp' || chr(160)
                      || replace(format('{:,}', abs(f.amount)), ',', '.')
                 ELSE CAST(f.amount AS VARCHAR) END AS value
        FROM (VALUES ('admin', 1, 'Total Produk', 'totalProducts', false), ('admin', 2, 'Total Pengguna', 'totalUsers', false),
            ('admin', 3, 'Total Pelanggan', 'totalCustomers', false), ('admin', 4, 'Penjualan Hari Ini', 'todaySales', true),
            ('kasir', 1, 'Transaksi Hari Ini', 'todaySales', true), ('kasir', 2, 'Pendapatan Hari Ini', 'todayGrossRevenue', true),
            ('kasir', 3, 'Produk Tersedia', 'totalProducts', false), ('gudang', 1, 'Total Produk', 'totalProducts', false),
            ('gudang', 2, 'Stok Menipis', 'lowStock', false), ('gudang', 3, 'Supplier', 'totalSuppliers', false),
            ('gudang', 4, 'Pelanggan', 'totalCustomers', false)) AS l(role, position, label, figure, money)
        JOIN figures AS f ON f.figure = l.figure""",
    # ---- products ----
    "sales_by_product": """SELECT x.product_id, p.code AS current_code, p.name AS current_name, p.unit AS current_unit,
            x.total_qty, x.total_revenue, x.total_capital, x.total_profit
        FROM sums_by_product AS x LEFT JOIN products AS p ON p.id = x.product_id""",
    "top_products": """SELECT x.product_id, p.name AS current_name, x.total_revenue
        FROM sums_by_product AS x LEFT JOIN products AS p ON p.id = x.product_id
        ORDER BY x.total_revenue DESC, x.product_id NULLS FIRST LIMIT 10""",
    "report_row_number": """SELECT row_number() OVER (ORDER BY total_revenue DESC, product_id NULLS FIRST) AS no, product_id,
            total_revenue FROM sums_by_product""",
    "printed_products": """SELECT row_number() OVER (ORDER BY x.total_revenue DESC, x.product_id NULLS FIRST) AS no,
            coalesce(p.name, 'ID:' || coalesce(CAST(x.product_id AS VARCHAR), 'null')) AS name, x.total_qty AS qty,
            'Rp ' || replace(format('{:,}', x.total_revenue), ',', '.') AS revenue,
            'Rp ' || replace(format('{:,}', x.total_capital), ',', '.') AS capital,
            'Rp ' || replace(format('{:,}', coalesce(x.total_profit, 0)), ',', '.') AS profit
        FROM sums_by_product AS x LEFT JOIN products AS p ON p.id = x.product_id""",
    "product_report_with_total": """SELECT x.product_id,
            coalesce(p.name, 'ID:' || coalesce(CAST(x.product_id AS VARCHAR), 'null')) AS label, false AS is_total,
            x.total_qty, x.total_revenue, x.total_capital, x.total_profit
        FROM sums_by_product AS x LEFT JOIN products AS p ON p.id = x.product_id
        UNION ALL
        SELECT NULL, 'TOTAL', true, CAST(SUM(total_qty) AS BIGINT), CAST(SUM(total_revenue) AS BIGINT),
            CAST(SUM(total_capital) AS BIGINT), CAST(coalesce(SUM(total_profit), 0) AS BIGINT) FROM sums_by_product""",
    "product_label": """SELECT l.id, coalesce(p.name, 'ID:' || coalesce(CAST(l.product_id AS VARCHAR), 'null')) AS label
        FROM lines AS l LEFT JOIN products AS p ON p.id = l.product_id""",
    # ---- lists ----
    "recent_sales": """SELECT l.id, l.product_id AS "productId", p.name AS "productName", l.quantity,
            l.total_price AS "totalPrice"
        FROM sales AS l LEFT JOIN products AS p ON p.id = l.product_id
        ORDER BY l.id DESC, l.product_id DESC NULLS LAST, l.quantity DESC, l.total_price DESC LIMIT 7""",
    "recent_sales_receipts": """SELECT l.id, l.product_id AS "productId", CAST(NULL AS VARCHAR) AS "productName", l.quantity,
            l.total_price AS "totalPrice"
        FROM lines AS l JOIN receipts AS r ON r.id = l.receipt_id
        ORDER BY l.id DESC, l.product_id DESC NULLS LAST, l.quantity DESC, l.total_price DESC LIMIT 7""",
    "with_product_name": """SELECT l.id, l.product_id, l.quantity, l.total_price, p.name AS "productName"
        FROM sales AS l LEFT JOIN products AS p ON p.id = l.product_id""",
    "recent_logs": """SELECT id, type, product_id AS "productId", quantity, note, created_at
        FROM logs ORDER BY created_at DESC, id DESC LIMIT 8""",
    "log_label": """SELECT id, created_at, CASE type WHEN 'sell' THEN 'Penjualan' WHEN 'incoming' THEN 'Barang masuk'
            WHEN 'delete' THEN 'Hapus produk' ELSE 'Aktivitas' END AS label,
            CASE WHEN coalesce(product_id, 0) = 0 THEN '—' ELSE CAST(product_id AS VARCHAR) END AS product,
            coalesce(CAST(quantity AS VARCHAR), '—') AS quantity FROM logs""",
    "list_incoming": """SELECT i.*, p.name AS product_name, s.name AS supplier_name
        FROM incoming AS i LEFT JOIN products AS p ON p.id = i.product_id LEFT JOIN suppliers AS s ON s.id = i.supplier_id""",
    "incoming_display": """SELECT i.id, i.date_in, i.quantity, coalesce(p.name, '—') AS product, coalesce(s.name, '—') AS supplier,
            i.staff_name AS staff
        FROM incoming AS i LEFT JOIN products AS p ON p.id = i.product_id LEFT JOIN suppliers AS s ON s.id = i.supplier_id""",
    "list_outgoing": """SELECT id, ship_date AS date_out, product_id, quantity, line_status AS destination,
        CAST(NULL AS VARCHAR) AS staff_name FROM lines""",
    "count_session_log": """SELECT h.session_id AS id, h.counted_at, h.staff_name, h.note, COUNT(c.line) AS item_count
        FROM count_heads AS h LEFT JOIN counted AS c ON c.session_id = h.session_id
        GROUP BY h.session_id, h.counted_at, h.staff_name, h.note ORDER BY id DESC LIMIT 20""",
    "count_session_sizes": """SELECT h.session_id AS id, h.counted_at, h.staff_name, h.note, COUNT(c.line) AS item_count
        FROM count_heads AS h LEFT JOIN counted AS c ON c.session_id = h.session_id
        GROUP BY h.session_id, h.counted_at, h.staff_name, h.note""",
    "count_sheet": """SELECT id AS "productId", name AS "productName", code, category_name, supplier_name,
        coalesce(stock, 0) AS "systemStock", coalesce(stock, 0) AS "countedStock", CAST(0 AS BIGINT) AS difference FROM catalog""",
    "count_sign": """SELECT session_id, line, difference,
            CASE WHEN difference = 0 THEN 'equal' WHEN difference > 0 THEN 'over' WHEN difference < 0 THEN 'short' END AS sign,
            CASE WHEN difference > 0 THEN '+' || CAST(difference AS VARCHAR) ELSE CAST(difference AS VARCHAR) END AS difference_text
        FROM counted""",
    "sales_on": "SELECT id, product_id, quantity, total_price FROM sales WHERE date = (SELECT MAX(date) FROM sales)",
    "sales_between": """SELECT id, product_id, quantity, total_price FROM sales
        WHERE date BETWEEN DATE '1998-01-01' AND DATE '1998-12-31'""",
    # ---- receipts ----
    "receipt_items": """SELECT id, receipt_id, product_id, quantity, price, total_price FROM lines
        WHERE receipt_id = (SELECT MAX(receipt_id) FROM lines) ORDER BY id""",
    "receipt_lines": """SELECT id, receipt_id, date, cashier_name, payment_method, product_id, total_price FROM sales""",
    "receipt_reconcile": """SELECT r.id, r.subtotal, r.total_items, CAST(SUM(l.total_price) AS BIGINT) AS items_subtotal,
            CAST(SUM(l.quantity) AS BIGINT) AS items_quantity,
            r.subtotal = SUM(l.total_price) AND r.total_items = SUM(l.quantity) AS balanced
        FROM receipts AS r JOIN lines AS l ON l.receipt_id = r.id GROUP BY r.id, r.subtotal, r.total_items""",
    "receipt_document": """SELECT r.id AS receipt_id, CAST(0 AS BIGINT) AS page, '#' || CAST(r.id AS VARCHAR) AS number,
            CAST(r.date AS VARCHAR) AS day_text, r.cashier_name, r.payment_method,
            string_agg('null | ' || CAST(l.quantity AS VARCHAR) || ' | Rp ' || replace(format('{:,}', l.price), ',', '.')
                || ' | Rp ' || replace(format('{:,}', l.total_price), ',', '.'), chr(10)
                ORDER BY l.id, l.product_id NULLS FIRST, l.quantity, l.total_price) AS lines_text,
            'Rp ' || replace(format('{:,}', r.subtotal), ',', '.') AS total_text
        FROM receipts AS r JOIN lines AS l ON l.receipt_id = r.id
        GROUP BY r.id, r.date, r.cashier_name, r.payment_method, r.subtotal""",
    # ---- baskets ----
    "cumulative_cart_check": "SELECT cart_id, line, product_id, quantity, stock_left, reason FROM cumulative_lines",
    "live_cart_stock": """SELECT c.cart_id, c.line, c.product_id, coalesce(p.stock, c.quantity, 0) AS stock
        FROM cart_numbers AS c LEFT JOIN products AS p ON p.id = c.product_id""",
    "basket_totals": """SELECT cart_id, CAST(coalesce(SUM(total_price), 0) AS BIGINT) AS subtotal,
            CAST(SUM(quantity) AS BIGINT) AS total_items, COUNT(*) AS line_count,
            CAST(coalesce(SUM(purchase_price * quantity), 0) AS BIGINT) AS cost,
            CAST(coalesce(SUM(profit_per_unit * quantity), 0) AS BIGINT) AS profit
        FROM priced GROUP BY cart_id""",
    "basket_discount_tax": """SELECT cart_id, subtotal, CAST(greatest(0, subtotal * (100 - off)) AS DOUBLE) / 100 AS discounted,
            CAST(greatest(0, subtotal * (100 - off)) * 111 AS DOUBLE) / 10000 AS grand_total
        FROM (SELECT cart_id, CAST(coalesce(SUM(total_price), 0) AS BIGINT) AS subtotal, cart_id % 120 AS off
              FROM priced GROUP BY cart_id) AS t""",
    "checkout_snapshot": "SELECT * FROM snapshot_verdicts",
    "checkout_cumulative": "SELECT * FROM cumulative_verdicts",
    "checkout_receipts": "SELECT * FROM snapshot_receipts",
    "checkout_items": """SELECT receipt_id, line, product_id, quantity, price, total_price, product_code, product_name, unit,
        purchase_price, price AS sale_price, profit_per_unit FROM snapshot_sold""",
    "checkout_sales": """SELECT date, cashier_name, product_id, quantity, price, total_price, payment_method, product_code,
        product_name, unit, purchase_price, price AS sale_price, profit_per_unit FROM snapshot_sold""",
    "checkout_logs": """SELECT 'sell' AS type, product_id, quantity,
        'Penjualan x' || CAST(quantity AS VARCHAR) || ' (metode: ' || payment_method || ')' AS note FROM snapshot_sold""",
    "checkout_stock": """SELECT p.id, p.stock - coalesce(m.used, 0) AS stock FROM products AS p LEFT JOIN (
        SELECT product_id, CAST(SUM(quantity) AS BIGINT) AS used FROM snapshot_sold GROUP BY product_id) AS m
        ON m.product_id = p.id""",
    # ---- maintenance ----
    "validate_batch": """SELECT id, name, address, phone, email,
        CASE WHEN email IS NULL THEN 'invalid_data' END AS reject_reason FROM suppliers""",
    "validate_movements": """SELECT seq, product_id, CASE WHEN coalesce(product_id, 0) = 0 OR quantity <= 0
        THEN 'invalid_data' END AS reject_reason FROM incoming_requests""",
    "unknown_products": """SELECT c.cart_id, c.line, c.product_id FROM cart_lines AS c
        WHERE NOT EXISTS (SELECT 1 FROM products AS p WHERE p.id = c.product_id)""",
    "apply_movements": """SELECT p.id, p.code, p.stock + coalesce(m.delta, 0) AS stock FROM products AS p LEFT JOIN (
        SELECT product_id, CAST(SUM(quantity) AS BIGINT) AS delta FROM incoming GROUP BY product_id) AS m
        ON m.product_id = p.id""",
    "upsert": """SELECT p.id, CASE WHEN c.id IS NULL THEN p.code ELSE '' END AS code,
            CASE WHEN c.id IS NULL THEN p.name ELSE 'Baru ' || CAST(c.line_number AS VARCHAR) END AS name,
            CASE WHEN c.id IS NULL THEN p.category_id END AS category_id,
            CASE WHEN c.id IS NULL THEN p.unit ELSE '' END AS unit,
            CASE WHEN c.id IS NULL THEN p.purchase_price ELSE 0 END AS purchase_price,
            CASE WHEN c.id IS NULL THEN p.sale_price ELSE c.price END AS sale_price,
            CASE WHEN c.id IS NULL THEN p.stock ELSE c.quantity END AS stock,
            CASE WHEN c.id IS NULL THEN p.entry_date END AS entry_date,
            CASE WHEN c.id IS NULL THEN p.storage_location ELSE '' END AS storage_location,
            CASE WHEN c.id IS NULL THEN p.supplier_id WHEN c.supplier_key <> 0 THEN c.supplier_key END AS supplier_id
        FROM products AS p LEFT JOIN last_changes AS c ON c.id = p.id""",
    "remove_ids": """SELECT id, code, name FROM products
        WHERE id NOT IN (SELECT product_id FROM logs WHERE type = 'delete')""",
    "delete_with_log": """SELECT 'delete' AS type, product_id, CAST(0 AS BIGINT) AS quantity,
        'Hapus produk #' || CAST(product_id AS VARCHAR) AS note FROM logs WHERE type = 'delete'""",
    "create_products": """SELECT id, code, name, category_id, unit, purchase_price, sale_price, stock,
        CAST(NULL AS DATE) AS entry_date, 'Rak' AS storage_location, CAST(NULL AS BIGINT) AS supplier_id FROM created""",
    "create_products_logs": """SELECT 'create' AS type, CAST(NULL AS BIGINT) AS product_id, stock AS quantity,
        'Menambah produk ' || name AS note FROM created""",
    "create_products_rejects": "SELECT seq, code, reject_reason FROM offers_judged WHERE reject_reason IS NOT NULL",
    "append_batch": """SELECT (SELECT MAX(id) FROM suppliers) + row_number() OVER (ORDER BY c_custkey) AS id,
        c_name AS name, c_mktsegment AS address FROM customer""",
    "receive_goods": """SELECT seq, (SELECT MAX(date) FROM sales) AS date_in, product_id, quantity, supplier_id, staff_name
        FROM incoming_judged WHERE reject_reason IS NULL""",
    "receive_goods_logs": """SELECT 'incoming' AS type, product_id, quantity,
        'Barang masuk x' || CAST(quantity AS VARCHAR) || ' (staff: ' || staff_name || ')' AS note
        FROM incoming_judged WHERE reject_reason IS NULL""",
    "receive_goods_rejects": "SELECT seq, product_id, reject_reason FROM incoming_judged WHERE reject_reason IS NOT NULL",
    "receive_goods_stock": """SELECT p.id, p.stock + coalesce(m.delta, 0) AS stock FROM products AS p LEFT JOIN (
        SELECT product_id, CAST(SUM(quantity) AS BIGINT) AS delta FROM incoming_judged WHERE reject_reason IS NULL
        GROUP BY product_id) AS m ON m.product_id = p.id""",
    "stock_count": """SELECT session_id, line, product_id, system_stock, counted_stock, difference, note FROM count_kept""",
    "stock_count_rejects": """SELECT session_id, counted_at, staff_name, note, reject_reason FROM count_reasons
        WHERE reject_reason IS NOT NULL""",
    "stock_count_logs": """SELECT 'stock_opname' AS type, product_id, difference AS quantity,
        'Stok opname (' || staff_name || '): ' || CAST(counted_stock AS VARCHAR) AS note FROM count_kept""",
    "stock_count_stock": """SELECT p.id, p.stock + coalesce(m.delta, 0) AS stock FROM products AS p LEFT JOIN (
        SELECT product_id, CAST(SUM(difference) AS BIGINT) AS delta FROM count_kept GROUP BY product_id) AS m
        ON m.product_id = p.id""",
    # ---- scalars ----
    "ensure_number": """SELECT cart_id, line, quantity_text AS raw, CAST(quantity AS DOUBLE) AS number FROM cart_numbers""",
    "text_or": """SELECT seq, staff_name, CASE WHEN supplier_id IS NULL THEN '-' ELSE CAST(supplier_id AS VARCHAR) END AS supplier
        FROM incoming_requests""",
    "format_rp": """SELECT id, 'Rp ' || replace(format('{:,}', total_price), ',', '.') AS rp,
        CASE WHEN profit_per_unit < 0 THEN '-' ELSE '' END || 'Rp' || chr(160)
            || replace(format('{:,}', abs(coalesce(profit_per_unit, 0))), ',', '.') AS idr FROM lines""",
    "format_short": """SELECT id, CASE WHEN n = 0 THEN '0'
            WHEN n >= 1000000 THEN 'Rp' || CAST((n + 50000) // 100000 // 10 AS VARCHAR)
                || CASE WHEN (n + 50000) // 100000 % 10 <> 0 THEN '.' || CAST((n + 50000) // 100000 % 10 AS VARCHAR) ELSE '' END || 'M'
            WHEN n >= 1000 THEN 'Rp' || CAST((n + 500) // 1000 AS VARCHAR) || 'K'
            ELSE 'Rp' || CAST(n AS VARCHAR) END AS short
        FROM (SELECT id, CASE line_number WHEN 1 THEN quantity WHEN 2 THEN price // 100 WHEN 3 THEN -price WHEN 4 THEN 0
                  ELSE total_price END AS n FROM lines) AS a""",
    "day_label": """SELECT id, CASE dayofweek(date_in) WHEN 0 THEN 'Min' WHEN 1 THEN 'Sen' WHEN 2 THEN 'Sel' WHEN 3 THEN 'Rab'
                 WHEN 4 THEN 'Kam' WHEN 5 THEN 'Jum' ELSE 'Sab' END || ', ' || strftime(date_in, '%d') || ' ' ||
            CASE month(date_in) WHEN 1 THEN 'Jan' WHEN 2 THEN 'Feb' WHEN 3 THEN 'Mar' WHEN 4 THEN 'Apr' WHEN 5 THEN 'Mei'
                 WHEN 6 THEN 'Jun' WHEN 7 THEN 'Jul' WHEN 8 THEN 'Agu' WHEN 9 THEN 'Sep' WHEN 10 THEN 'Okt'
                 WHEN 11 THEN 'Nov' ELSE 'Des' END AS label FROM incoming""",
    "local_datetime": """SELECT id, CAST(created_at AS DATE) AS day, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS utc_text,
        strftime(created_at + INTERVAL 7 HOUR, '%Y-%m-%d %H:%M:%S') AS jakarta_text, substr(CAST(created_at AS VARCHAR), 1, 16) AS minute
        FROM logs""",
    "movement_note": """SELECT id, 'Penjualan x' || CAST(quantity AS VARCHAR) || ' (metode: ' || payment_method || ')' AS sell,
        'Barang masuk x' || CAST(quantity AS VARCHAR) || ' (staff: ' || cashier_name || ')' AS incoming,
        'Stok opname (' || cashier_name || '): ' || CAST(quantity AS VARCHAR) AS stock_opname,
        'Hapus produk #' || CAST(product_id AS VARCHAR) AS "delete" FROM sales""",
    "period_report_files": """SELECT row_number() OVER (ORDER BY x.total_revenue DESC, x.product_id NULLS FIRST) AS no,
            coalesce(p.name, 'ID:' || coalesce(CAST(x.product_id AS VARCHAR), 'null')) AS name, x.total_qty AS qty,
            'Rp ' || replace(format('{:,}', x.total_revenue), ',', '.') AS revenue,
            'Rp ' || replace(format('{:,}', x.total_capital), ',', '.') AS capital,
            'Rp ' || replace(format('{:,}', coalesce(x.total_profit, 0)), ',', '.') AS profit,
            'Periode: 1998-01-01 s/d 1998-12-31' AS period_label
        FROM (SELECT product_id, CAST(SUM(quantity) AS BIGINT) AS total_qty, CAST(SUM(total_price) AS BIGINT) AS total_revenue,
                  CAST(SUM(coalesce(purchase_price, 0) * quantity) AS BIGINT) AS total_capital,
                  CAST(SUM(profit_per_unit * quantity) AS BIGINT) AS total_profit
              FROM sales WHERE date BETWEEN DATE '1998-01-01' AND DATE '1998-12-31' GROUP BY product_id) AS x
        LEFT JOIN products AS p ON p.id = x.product_id""",
    "period_report_totals": """SELECT CAST(SUM(total_price) AS BIGINT) AS gross, CAST(COUNT(*) AS BIGINT) AS lines,
            CAST(SUM(profit_per_unit * quantity) AS BIGINT) AS net, CAST(SUM(quantity) AS BIGINT) AS total_qty,
            CAST(COUNT(DISTINCT coalesce(product_id, -1)) + 1 AS BIGINT) AS report_rows,
            (SELECT CAST(COUNT(*) AS BIGINT) FROM products) AS products,
            (SELECT CAST(SUM(stock) AS BIGINT) FROM products) AS stock
        FROM sales WHERE date BETWEEN DATE '1998-01-01' AND DATE '1998-12-31'""",
    "daily_tables": """SELECT id, product_id, quantity, total_price, date FROM sales
        WHERE date BETWEEN DATE '1998-03-01' AND DATE '1998-03-07'""",
    "receipt_export_files": """SELECT r.id AS receipt_id, '#' || CAST(r.id AS VARCHAR) AS number,
            'Rp ' || replace(format('{:,}', r.subtotal), ',', '.') AS total_text, CAST(COUNT(*) AS BIGINT) AS n_items
        FROM receipts AS r JOIN lines AS l ON l.receipt_id = r.id GROUP BY r.id, r.subtotal""",
    "apply_defaults": """SELECT id, name, CAST(0 AS BIGINT) AS points FROM customers""",
    "seed_if_empty": """SELECT id, name, description FROM categories UNION ALL SELECT * FROM (VALUES
        (CAST(1 AS BIGINT), 'Elektronik', 'Perangkat elektronik dan aksesoris'),
        (2, 'Fashion', 'Pakaian dan aksesori mode'), (3, 'Makanan', 'Bahan makanan dan snack'),
        (4, 'Minuman', 'Minuman kemasan dan segar'),
        (5, 'Rumah Tangga', 'Peralatan rumah tangga dan kebutuhan sehari-hari'),
        (6, 'Perawatan', 'Produk kebersihan dan perawatan diri')) AS v(id, name, description)""",
    "validate_categories": """SELECT id, name, CASE WHEN id % 2 = 0 THEN 'invalid_data' END AS reject_reason FROM categories""",
    "validate_customers": """SELECT id, email, CASE WHEN points < 0 THEN 'invalid_data' END AS reject_reason FROM customers""",
    "upsert_suppliers": """SELECT id, CASE WHEN email IS NULL THEN name ELSE 'Baru' END AS name,
        CASE WHEN email IS NULL THEN address ELSE name END AS address, phone, email FROM suppliers""",
    "refused_changes": """SELECT id AS seq, product_id AS id FROM lines WHERE line_number = 6""",
    # ---- streams: the batch result on the same rows ----
    "sales_trend_stream": """SELECT CAST(created_at AS DATE) AS day, CAST(SUM(quantity * 100) AS BIGINT) AS total_gross,
            CAST(SUM(CASE WHEN product_id IS NULL THEN 0 ELSE quantity * 80 END) AS BIGINT) AS total_capital,
            CAST(SUM(CASE WHEN product_id IS NULL THEN 0 ELSE quantity * 20 END) AS BIGINT) AS total_net
        FROM logs GROUP BY CAST(created_at AS DATE)""",
    "movement_stream": """SELECT p.id, p.stock + coalesce(m.delta, 0) AS stock FROM products AS p LEFT JOIN (
        SELECT product_id, CAST(SUM(quantity) AS BIGINT) AS delta FROM logs GROUP BY product_id) AS m ON m.product_id = p.id""",
}

_SECTIONS = {
    "finance": _KEPT["period_finance_1998"], "counts": _KEPT["entity_counts"], "stock": _KEPT["price_list"],
    "products_total": _KEPT["product_report_with_total"].replace("sums_by_product", "sums_1998"),
}
for _part, _sql in _SECTIONS.items():
    _KEPT[f"period_report_{_part}"] = f"SELECT s.*, 'Periode: 1998-01-01 s/d 1998-12-31' AS period_label FROM ({_sql}) AS s"
_KEPT["receipt_lines_bucketed"] = _KEPT["receipt_lines"]
for _part in ("receipts", "items", "logs", "stock"):
    _KEPT[f"checkout_cumulative_{_part}"] = _KEPT[f"checkout_{_part}"].replace("snapshot", "cumulative")

_HAND_OUT = """
walk AS (
    SELECT DISTINCT product_id, CAST(0 AS BIGINT) AS nth, stock_now AS left_over, CAST(NULL AS BOOLEAN) AS taken
    FROM requests WHERE early_reason IS NULL
    UNION ALL
    SELECT r.product_id, r.nth, CASE WHEN r.quantity <= w.left_over THEN w.left_over - r.quantity ELSE w.left_over END,
        r.quantity <= w.left_over
    FROM walk AS w JOIN requests AS r ON r.product_id = w.product_id AND r.nth = w.nth + 1)"""
_SELL = """SELECT r.seq, r.product_id, r.quantity,
    coalesce(r.early_reason, CASE WHEN NOT w.taken THEN 'not_enough_stock' END) AS reason
FROM requests AS r LEFT JOIN walk AS w ON w.product_id = r.product_id AND w.nth = r.nth"""


def oracle_sql() -> dict[str, str]:
    statements = {name: _with_views(sql) for name, sql in _KEPT.items()}
    statements["sell"] = _with_views(_SELL, _HAND_OUT)
    statements["sell_stream"] = _with_views(
        _SELL.replace("requests", "log_requests").replace("r.quantity,", "r.quantity, r.price, r.total_price,"),
        _HAND_OUT.replace("requests", "log_requests"),
    )
    return statements
