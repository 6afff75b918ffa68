"""DuckDB SQL of the fixture views (FIXTURES.md part B), used to build oracle queries.

``with_views(body)`` prepends, as CTEs, every view the body mentions (and the
views those depend on), so each oracle string runs on the bare driver tables.
"""

from __future__ import annotations

import re

VIEWS: dict[str, str] = {}

VIEWS["act_names"] = """SELECT * FROM (VALUES (0,'INFORM'),(1,'REQUEST'),(2,'CONFIRM'),(3,'OFFER'),(4,'SELECT'),
(5,'NOTIFY_SUCCESS'),(6,'INFORM_COUNT'),(7,'OFFER_INTENT'),(8,'REQ_MORE'),(9,'GOODBYE')) AS t(act, act_name)"""

VIEWS["acts"] = """SELECT o.o_orderkey AS turn_key,
       concat('1_', lpad(cast(o.o_custkey AS varchar(20)), CAST(greatest(5, length(cast(o.o_custkey AS varchar(20)))) AS INTEGER), '0')) AS dialog_id,
       CASE WHEN o.o_orderkey % 10 < 8 THEN 'train' WHEN o.o_orderkey % 10 = 8 THEN 'validation' ELSE 'test' END AS split,
       concat(substr(c.c_mktsegment,1,1), lower(substr(c.c_mktsegment,2)), '_', cast(c.c_nationkey % 3 + 1 AS varchar(20))) AS service,
       CAST(row_number() OVER (PARTITION BY o.o_orderkey ORDER BY l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_extendedprice) - 1 AS INTEGER) AS act_pos,
       CASE l.l_linenumber WHEN 1 THEN 4 WHEN 2 THEN 3 WHEN 3 THEN 0 WHEN 4 THEN 6 WHEN 5 THEN 2 WHEN 6 THEN 0 ELSE 9 END AS act,
       CASE l.l_linenumber WHEN 1 THEN 'part_name' WHEN 2 THEN 'brand' WHEN 3 THEN 'ship_date' WHEN 4 THEN 'count' WHEN 5 THEN 'part_type' WHEN 6 THEN 'in_stock' ELSE '' END AS slot,
       CASE l.l_linenumber WHEN 1 THEN p.p_name WHEN 2 THEN p.p_brand WHEN 3 THEN substr(cast(l.l_shipdate AS varchar(30)),1,10)
            WHEN 4 THEN cast(cast(l.l_quantity AS int) AS varchar(20)) WHEN 5 THEN lower(p.p_type)
            WHEN 6 THEN CASE WHEN l.l_returnflag = 'R' THEN 'False' ELSE 'True' END ELSE NULL END AS value1,
       CASE WHEN l.l_linenumber = 1 AND l.l_quantity >= 40 THEN p.p_brand ELSE NULL END AS value2,
       (l.l_partkey + l.l_linenumber) % 9 = 0 AS dropped
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
JOIN lineitem l ON l.l_orderkey = o.o_orderkey JOIN part p ON p.p_partkey = l.l_partkey"""

VIEWS["turn_text"] = """SELECT turn_key, dialog_id, split, service,
  string_agg(CASE WHEN slot = '' THEN 'Goodbye and thanks.' WHEN value2 IS NOT NULL THEN concat('The ', slot, ' is ', value1, ' and ', value2, '.') ELSE concat('The ', slot, ' is ', value1, '.') END, ' ' ORDER BY act_pos) AS target,
  string_agg(CASE WHEN slot = '' THEN 'Goodbye.' WHEN dropped THEN concat('I found a ', slot, ' for you.') WHEN value2 IS NOT NULL THEN concat('The ', slot, ' is ', upper(value1), ' and ', value2, '.') ELSE concat('Its ', slot, ' is ', value1, '.') END, ' ' ORDER BY act_pos) AS pred
FROM acts GROUP BY turn_key, dialog_id, split, service"""

VIEWS["schema_slots"] = """SELECT s.service, concat('Find and order parts, ', lower(s.service)) AS service_desc, x.slot, x.slot_desc, x.is_categorical, x.possible_values, x.slot_pos
FROM (SELECT DISTINCT concat(substr(c_mktsegment,1,1), lower(substr(c_mktsegment,2)), '_', cast(c_nationkey % 3 + 1 AS varchar(20))) AS service FROM customer) s
CROSS JOIN (SELECT * FROM (VALUES ('part_name','Name of the part',false,'',0),('brand','Brand of the part',false,'',1),('ship_date','Date of shipping',false,'',2),('part_type','Kind of part',true,'small,medium,large',3),('in_stock','Whether the part is in stock',true,'True,False',4)) AS v(slot, slot_desc, is_categorical, possible_values, slot_pos)) x
WHERE NOT (s.service = 'Household_3' AND x.slot = 'brand')"""

VIEWS["templates"] = """SELECT s.service, x.act_key, x.template FROM (SELECT DISTINCT concat(substr(c_mktsegment,1,1), lower(substr(c_mktsegment,2)), '_', cast(c_nationkey % 3 + 1 AS varchar(20))) AS service FROM customer) s
CROSS JOIN (SELECT * FROM (VALUES ('SELECT!!part_name!!@','I picked the @.'),('SELECT!!part_name!!@@','I picked the @ made by @.'),('OFFER!!brand!!@','How about @?'),('INFORM!!ship_date!!@','It ships on @.'),('INFORM_COUNT!!FindParts!!count!!@','I found @ of them.'),('CONFIRM!!part_type!!@','The kind is @.'),('INFORM!!in_stock!!True','It is in stock.'),('INFORM!!in_stock!!False','It is out of stock.'),('GOODBYE','Have a nice day.')) AS v(act_key, template)) x"""

VIEWS["raw_turns"] = """SELECT concat('1_', lpad(cast(conv_id AS varchar(20)), CAST(greatest(5, length(cast(conv_id AS varchar(20)))) AS INTEGER), '0')) AS dialog_id, turn AS pos,
       CASE WHEN role = 'assistant' THEN 'SYSTEM' ELSE 'USER' END AS speaker, text AS utterance
FROM conversations"""

VIEWS["prepared_turns"] = """SELECT dialog_id, ord AS turn_id, CASE WHEN ord = 2 THEN lower(utterance) ELSE utterance END AS target
FROM (SELECT dialog_id, pos, utterance, row_number() OVER (PARTITION BY dialog_id ORDER BY pos) AS ord
      FROM raw_turns WHERE speaker = 'SYSTEM') t
UNION ALL
SELECT dialog_id, 99 AS turn_id, 'extra' AS target FROM (SELECT DISTINCT dialog_id FROM raw_turns WHERE pos = 0) d WHERE dialog_id LIKE '%0'"""

# Named acts with a list of values (the nested act's fields in long form).
VIEWS["named_acts"] = """SELECT a.*, n.act_name,
       CASE WHEN value1 IS NULL THEN [] WHEN value2 IS NULL THEN [value1] ELSE [value1, value2] END AS vals
FROM acts a JOIN act_names n ON a.act = n.act"""

# Paper-naive text (L2) of every turn; the decodes' model input ``sr``.
VIEWS["paper_text"] = """SELECT turn_key, string_agg(CASE WHEN len(vals) > 0 THEN concat(act_name, ' ( ', slot, ' = ', array_to_string(vals, ' '), ' )')
  WHEN slot <> '' THEN concat(act_name, ' ( ', slot, ' )') ELSE act_name END, ' ' ORDER BY act_pos) AS sr
FROM named_acts GROUP BY turn_key"""

VIEWS["decodes"] = """SELECT t.turn_key AS row_idx, t.target AS ref, t.pred, p.sr, t.service
FROM turn_text t JOIN paper_text p ON p.turn_key = t.turn_key WHERE t.split = 'test'"""

VIEWS["decodes2"] = """SELECT row_idx, ref, CASE WHEN row_idx % 3 = 0 THEN ref ELSE pred END AS pred, sr, service FROM decodes"""

VIEWS["perm_slots"] = """SELECT DISTINCT service, slot FROM schema_slots WHERE NOT is_categorical"""

# Strict / three-valued slot error of every decode row (A2, A5).
VIEWS["row_ser"] = """SELECT d.row_idx, d.service, split_part(d.service, '_', 1) AS domain,
       coalesce(e.err, false) AS has_slot_error,
       CASE WHEN e.n_vals > 0 THEN e.err ELSE NULL END AS ser_applicable
FROM decodes d LEFT JOIN (
  SELECT a.turn_key,
         bool_or(list_bool_or(list_transform(a.vals, lambda v: NOT contains(lower(d2.pred), lower(v))))) AS err,
         sum(len(a.vals)) AS n_vals
  FROM named_acts a JOIN perm_slots p ON p.service = a.service AND p.slot = a.slot
  JOIN decodes d2 ON d2.row_idx = a.turn_key GROUP BY a.turn_key) e ON e.turn_key = d.row_idx"""

ORDER = ["act_names", "acts", "turn_text", "schema_slots", "templates", "raw_turns", "prepared_turns",
         "named_acts", "paper_text", "decodes", "decodes2", "perm_slots", "row_ser"]


def _mentions(sql: str, name: str) -> bool:
    return re.search(rf"\b{name}\b", sql) is not None


def with_views(body: str) -> str:
    """Prefix ``body`` with the CTEs of every fixture view it needs."""
    need: set[str] = set()
    frontier = [body]
    while frontier:
        s = frontier.pop()
        for n in ORDER:
            if n not in need and _mentions(s, n):
                need.add(n)
                frontier.append(VIEWS[n])
    ctes = [f"{n} AS ({VIEWS[n]})" for n in ORDER if n in need]
    body = body.strip()
    if not ctes:
        return body
    if body.upper().startswith("WITH "):
        return "WITH " + ",\n".join(ctes) + ",\n" + body[5:]
    return "WITH " + ",\n".join(ctes) + "\n" + body
