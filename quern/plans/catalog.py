"""The registered queries of the filter language: program, table, and the equivalent DuckDB query.

Each entry runs its program over its whole table through ``quern.api.run``.  A NATIVE entry must
compile to DataFrame operators; a KERNEL entry is run by the row interpreter and gives JSON text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..api import run

#: name: (mode, table, side tables, program, DuckDB query)
NATIVE: dict[str, tuple] = {
    "group_agg": (
        "slurp", "orders", {},
        "map(select(.o_totalprice > 100000)) | group_by(.o_orderpriority) | map({o_orderpriority: .[0].o_orderpriority, orders: length, spent: (map(.o_totalprice) | add | . * 100 | round | . / 100)})",
        "SELECT o_orderpriority, count(*) AS orders, round(sum(o_totalprice) * 100) / 100 AS spent FROM orders WHERE o_totalprice > 100000 GROUP BY 1",
    ),
    "group_two_keys": (
        "slurp", "lineitem", {},
        "group_by(.l_returnflag, .l_linestatus) | map({l_returnflag: .[0].l_returnflag, l_linestatus: .[0].l_linestatus, n: length, qty: (map(.l_quantity) | add), avg_disc: ((map(.l_discount) | add) / length * 1e6 | round), disc: (map(.l_extendedprice * (1 - .l_discount)) | add | round)})",
        "SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS qty, round(sum(l_discount) / count(*) * 1e6) AS avg_disc, round(sum(l_extendedprice * (1 - l_discount))) AS disc FROM lineitem GROUP BY ALL",
    ),
    "filter_project": ("each", "customer", {}, "select(.c_acctbal > 5000 and .c_mktsegment != \"BUILDING\") | {c_custkey, c_name}", "SELECT c_custkey, c_name FROM customer WHERE c_acctbal > 5000 AND c_mktsegment <> 'BUILDING'"),
    "arithmetic": (
        "each", "lineitem", {}, "{l_orderkey, l_linenumber, net: (.l_extendedprice * (1 - .l_discount) * 100 | floor), half: (.l_quantity / 2), odd: (.l_orderkey % 7), neg: (-.l_quantity + 1)}",
        "SELECT l_orderkey, l_linenumber, floor(l_extendedprice * (1 - l_discount) * 100) AS net, l_quantity / 2 AS half, (l_orderkey % 7)::DOUBLE AS odd, -l_quantity + 1 AS neg FROM lineitem",
    ),
    "running_foreach": (
        "slurp", "events", {}, "group_by(.user_id)[] | foreach .[] as $e (0; . + ($e.value * 100 | round); {event_id: $e.event_id, running: .})",
        "SELECT event_id, sum(round(value * 100)) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS running FROM events",
    ),
    "unique_by": ("slurp", "orders", {}, "unique_by(.o_custkey) | map({o_custkey, o_orderkey})", "SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY 1"),
    "unique": ("slurp", "part", {}, "map(.p_brand) | unique | .[] | {brand: .}", "SELECT DISTINCT p_brand AS brand FROM part"),
    "index_join": (
        "slurp", "orders", {"c": "customer"}, "INDEX($c[]; .c_custkey) as $i | JOIN($i; .[]; .o_custkey | tostring; {o_orderkey: .[0].o_orderkey, c_name: .[1].c_name})",
        "SELECT o_orderkey, c_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey",
    ),
    "inner_join": (
        "slurp", "supplier", {"n": "nation"}, ".[] as $s | $n[] as $n1 | select($s.s_nationkey == $n1.n_nationkey) | {s_name: $s.s_name, n_name: $n1.n_name}",
        "SELECT s_name, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey",
    ),
    "in_semi": (
        "slurp", "customer", {"o": "orders"}, "map(select(IN(.c_custkey; $o[] | select(.o_totalprice > 300000) | .o_custkey))) | map({c_custkey})",
        "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)",
    ),
    "minus_anti": ("slurp", "customer", {"o": "orders"}, "map(select(IN(.c_custkey; $o[] | select(.o_totalprice > 300000) | .o_custkey) | not)) | map({c_custkey})", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)"),
    "top_k": ("slurp", "orders", {}, "sort_by(-.o_totalprice, .o_orderkey) | .[:10] | map({o_orderkey, o_totalprice})", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10"),
    "top_k_per_group": (
        "slurp", "orders", {}, "group_by(.o_orderpriority)[] | sort_by(-.o_totalprice, .o_orderkey) | .[:3] | .[] | {o_orderpriority, o_orderkey}",
        "SELECT o_orderpriority, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) <= 3",
    ),
    "json_props": ("each", "events", {}, "{event_id, k: (.props | fromjson | .k | tonumber)}", "SELECT event_id, json_extract(props, '$.k')::DOUBLE AS k FROM events"),
    "regex": (
        "each", "part", {}, "select(.p_name | test(\"^[a-m]\")) | {p_partkey, b: (.p_brand | gsub(\"[0-9]+\"; \"#\"))}",
        "SELECT p_partkey, regexp_replace(p_brand, '[0-9]+', '#', 'g') AS b FROM part WHERE regexp_matches(p_name, '^[a-m]')",
    ),
    "dates": ("each", "orders", {}, "{o_orderkey, d: (.o_orderdate | todate), y: (.o_orderdate | gmtime | .[0]), s: .o_orderdate | strftime(\"%Y-%m\")}", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS d, year(o_orderdate)::DOUBLE AS y, strftime(o_orderdate, '%Y-%m') AS s FROM orders"),
    "explode_words": ("each", "part", {}, ".p_name | split(\" \") | .[] | {word: .}", "SELECT unnest(string_split(p_name, ' ')) AS word FROM part"),
    "formats": (
        "each", "part", {}, "{p_partkey, b: (.p_name | @base64), c: ([.p_partkey, .p_name, .p_brand] | @csv), h: (.p_type | @html), t: \"\\(.p_partkey)-\\(.p_brand)\"}",
        "SELECT p_partkey, base64(encode(p_name)) AS b, p_partkey || ',\"' || p_name || '\",\"' || p_brand || '\"' AS c, p_type AS h, p_partkey || '-' || p_brand AS t FROM part",
    ),
    "min_max_by": (
        "slurp", "orders", {}, "group_by(.o_orderstatus) | map({st: .[0].o_orderstatus, low: (min_by(.o_totalprice) | .o_orderkey), high: (max_by(.o_totalprice) | .o_orderkey), first: .[0].o_orderkey, dear: (map(.o_totalprice) | max)})",
        "SELECT o_orderstatus AS st, arg_min(o_orderkey, o_totalprice) AS low, arg_max(o_orderkey, o_totalprice) AS high, min(o_orderkey) AS first, max(o_totalprice) AS dear FROM orders GROUP BY 1",
    ),
    "any_all": (
        "slurp", "lineitem", {}, "group_by(.l_suppkey) | map({s: .[0].l_suppkey, big: any(.l_quantity >= 50), small: all(.l_quantity < 50), r: (map(select(.l_returnflag == \"R\")) | length), parts: (map(.l_partkey) | unique | length)})",
        "SELECT l_suppkey AS s, bool_or(l_quantity >= 50) AS big, bool_and(l_quantity < 50) AS small, count(*) FILTER (l_returnflag = 'R') AS r, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY 1",
    ),
    "global_agg": ("slurp", "lineitem", {}, "{n: length, q: (map(.l_quantity) | add), most: (map(.l_extendedprice) | max), least: (map(.l_discount) | min)}", "SELECT count(*) AS n, sum(l_quantity) AS q, max(l_extendedprice) AS most, min(l_discount) AS least FROM lineitem"),
    "reduce_keyed_sum": ("slurp", "lineitem", {}, "reduce .[] as $o ({}; .[$o.l_returnflag] += $o.l_quantity)", "SELECT l_returnflag AS key, sum(l_quantity) AS value FROM lineitem GROUP BY 1"),
    "alternative_if": (
        "each", "part", {}, "{p_partkey, band: (if .p_size < 10 then \"s\" elif .p_size < 30 then \"m\" else \"l\" end), x: (.missing // .p_brand), y: (if .p_size == 1 then null else .p_size end // -1)}",
        "SELECT p_partkey, CASE WHEN p_size < 10 THEN 's' WHEN p_size < 30 THEN 'm' ELSE 'l' END AS band, p_brand AS x, CASE WHEN p_size = 1 THEN -1 ELSE p_size END::DOUBLE AS y FROM part",
    ),
    "assignment": (
        "each", "nation", {}, ".n_name |= ascii_downcase | .n_regionkey += 1 | .twice = .n_nationkey * 2 | del(.n_nationkey)",
        "SELECT lower(n_name) AS n_name, (n_regionkey + 1)::DOUBLE AS n_regionkey, (n_nationkey * 2)::DOUBLE AS twice FROM nation",
    ),
    "strings": (
        "each", "customer", {}, "{c_custkey, up: (.c_mktsegment | ascii_upcase), n: (.c_name | length), cut: .c_name[:8], tail: .c_name[-3:], c: (.c_name | ltrimstr(\"Customer\")), s: (.c_name | startswith(\"Customer#0\")), i: (.c_name | index(\"#\"))}",
        "SELECT c_custkey, upper(c_mktsegment) AS up, length(c_name) AS n, substr(c_name, 1, 8) AS cut, right(c_name, 3) AS tail, CASE WHEN starts_with(c_name, 'Customer') THEN substr(c_name, 9) ELSE c_name END AS c, starts_with(c_name, 'Customer#0') AS s, nullif(instr(c_name, '#') - 1, -1)::DOUBLE AS i FROM customer",
    ),
    "math": (
        "each", "part", {}, "{p_partkey, r: (.p_retailprice | sqrt | . * 1e6 | round), l: (.p_retailprice | log10 | . * 1e6 | round), p: (pow(.p_size; 2)), c: (.p_retailprice | ceil)}",
        "SELECT p_partkey, round(sqrt(p_retailprice) * 1e6) AS r, round(log10(p_retailprice) * 1e6) AS l, pow(p_size, 2)::DOUBLE AS p, ceil(p_retailprice)::DOUBLE AS c FROM part",
    ),
    "array_ops": (
        "each", "embeddings", {}, "{vec_id, n: (.embedding | length), first: .embedding[0], pos: (.embedding | map(select(. > 0)) | length), back: .embedding[-1]}",
        "SELECT vec_id, len(embedding) AS n, embedding[1] AS first, len(list_filter(embedding, lambda x: x > 0)) AS pos, embedding[-1] AS back FROM embeddings",
    ),
    "sort_all": ("slurp", "nation", {}, "sort_by(.n_regionkey, .n_name) | map({n_name, n_regionkey})", "SELECT n_name, n_regionkey FROM nation"),
    "pick_del": ("each", "region", {}, "pick(.r_name) + {k: .r_regionkey}", "SELECT r_name, r_regionkey AS k FROM region"),
    "distinct_agg": ("slurp", "events", {}, "group_by(.event_type) | map({t: .[0].event_type, users: (map(.user_id) | unique | length), top: (map(.value) | max), low: (map(.value) | min)})", "SELECT event_type AS t, count(DISTINCT user_id) AS users, max(value) AS top, min(value) AS low FROM events GROUP BY 1"),
    "except_rows": (
        "slurp", "orders", {"c": "customer"}, "map(.o_custkey) - ($c | map(select(.c_acctbal > 0) | .c_custkey)) | .[] | {k: .}",
        "SELECT o_custkey AS k FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)",
    ),
    "intersect_rows": (
        "slurp", "supplier", {"n": "nation"}, "map(select(IN(.s_nationkey; $n[] | select(.n_regionkey < 2) | .n_nationkey))) | map({s_name})",
        "SELECT s_name FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 2)",
    ),
    "union_distinct": (
        "slurp", "customer", {"s": "supplier"}, "(map(.c_nationkey) + ($s | map(.s_nationkey))) | unique | .[] | {k: .}",
        "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier",
    ),
    "range_join": (
        "slurp", "region", {"n": "nation"}, ".[] as $r | $n[] as $m | select($m.n_nationkey > $r.r_regionkey and $m.n_nationkey < $r.r_regionkey + 3) | {r: $r.r_name, n: $m.n_name}",
        "SELECT r_name AS r, n_name AS n FROM region JOIN nation ON n_nationkey > r_regionkey AND n_nationkey < r_regionkey + 3",
    ),
    "skip_limit": (
        "slurp", "orders", {}, "sort_by(.o_orderkey) | .[5:12] | map({o_orderkey})",
        "SELECT o_orderkey FROM orders ORDER BY 1 LIMIT 7 OFFSET 5",
    ),
    "regex_splits": (
        "each", "part", {}, "{p_partkey, n: (.p_type | [splits(\"[ #]+\")] | length)}",
        "SELECT p_partkey, len(regexp_split_to_array(p_type, '[ #]+')) AS n FROM part",
    ),
    "slices": (
        "each", "embeddings", {}, "{vec_id, a: (.embedding[2:5] | add * 1e4 | round), m: (.embedding | max), lo: (.embedding | min), any: (.embedding | any(. > 0.3)), u: (.embedding | unique | length)}",
        "SELECT vec_id, round((embedding[3]::DOUBLE + embedding[4] + embedding[5]) * 1e4) AS a, list_max(embedding) AS m, list_min(embedding) AS lo, len(list_filter(embedding, lambda x: x > 0.3)) > 0 AS any, len(list_distinct(embedding)) AS u FROM embeddings",
    ),
    "array_reduce": (
        "each", "embeddings", {}, "{vec_id, s: (reduce .embedding[] as $x (0; . + $x * $x) | . * 1e4 | round), r: (.embedding | reverse | .[0]), t: (.embedding | sort | .[0])}",
        "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)) * 1e4) AS s, embedding[-1] AS r, list_min(embedding) AS t FROM embeddings",
    ),
    "uri_sh": (
        "each", "nation", {}, "{n_nationkey, u: (.n_name + \" &/é\" | @uri), s: (.n_name | @sh)}",
        "SELECT n_nationkey, url_encode(n_name) || '%20%26%2F%C3%A9' AS u, '''' || n_name || '''' AS s FROM nation",
    ),
    "trig": (
        "each", "customer", {}, "{c_custkey, s: (.c_acctbal | sin | . * 1e6 | round), a: (.c_acctbal | atan | . * 1e6 | round), e: (.c_acctbal / 1e4 | exp | . * 1e6 | round), f: (.c_acctbal | floor), t: (.c_acctbal | trunc), g: (.c_acctbal | fabs), c: (.c_nationkey | cbrt | . * 1e6 | round)}",
        "SELECT c_custkey, round(sin(c_acctbal) * 1e6) AS s, round(atan(c_acctbal) * 1e6) AS a, round(exp(c_acctbal / 1e4) * 1e6) AS e, floor(c_acctbal) AS f, trunc(c_acctbal) AS t, abs(c_acctbal) AS g, round(cbrt(c_nationkey) * 1e6) AS c FROM customer",
    ),
    "indices": (
        "each", "part", {}, "{p_partkey, i: (.p_brand | rindex(\"#\")), c: (.p_type | contains(\"E\")), l: (.p_name | length), b: (.p_name | utf8bytelength), e: (.p_type | endswith(\"R\"))}",
        "SELECT p_partkey, (instr(p_brand, '#') - 1)::DOUBLE AS i, contains(p_type, 'E') AS c, length(p_name) AS l, strlen(p_name) AS b, ends_with(p_type, 'R') AS e FROM part",
    ),
    "empty_all": (
        "slurp", "nation", {}, "{none: (map(select(.n_nationkey > 99)) | length), some: any(.[]; .n_regionkey == 3), every: all(.[]; .n_regionkey < 5)}",
        "SELECT count(*) FILTER (n_nationkey > 99) AS none, bool_or(n_regionkey = 3) AS some, bool_and(n_regionkey < 5) AS every FROM nation",
    ),
    "bare_add": ("slurp", "lineitem", {}, "map(.l_quantity) | add", "SELECT sum(l_quantity) AS value FROM lineitem"),
    "bare_max": ("slurp", "lineitem", {}, "map(.l_extendedprice) | max", "SELECT max(l_extendedprice) AS value FROM lineitem"),
    "bare_mean": ("slurp", "lineitem", {}, "map(.l_quantity) | add / length | . * 1e6 | round", "SELECT round(sum(l_quantity) / count(*) * 1e6) AS value FROM lineitem"),
    "row_first": ("slurp", "orders", {}, ".[0] | {o_orderkey, o_custkey}", "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 1"),
    "row_last": ("slurp", "orders", {}, "last | {o_orderkey, o_custkey}", "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey DESC LIMIT 1"),
    "row_third": ("slurp", "orders", {}, "nth(2) | {o_orderkey}", "SELECT o_orderkey FROM orders ORDER BY 1 LIMIT 1 OFFSET 2"),
    "rows_at_end": ("slurp", "orders", {}, ".[-4:] | map(.o_orderkey) | join(\",\")", "SELECT string_agg(k, ',' ORDER BY k) AS value FROM (SELECT o_orderkey AS k FROM orders ORDER BY 1 DESC LIMIT 4)"),
    "ordered_groups": ("slurp", "orders", {}, "group_by(.o_custkey) | map({c: .[0].o_custkey, n: length}) | .[:7] | map(\"\\(.c):\\(.n)\") | join(\" \")", "SELECT string_agg(c || ':' || n, ' ' ORDER BY c) AS value FROM (SELECT o_custkey AS c, count(*) AS n FROM orders GROUP BY 1 ORDER BY 1 LIMIT 7)"),
    "ordered_unique": ("slurp", "part", {}, "map(.p_brand) | unique | .[:5] | join(\",\")", "SELECT string_agg(b, ',' ORDER BY b) AS value FROM (SELECT DISTINCT p_brand AS b FROM part ORDER BY 1 LIMIT 5)"),
    "ordered_unique_by": ("slurp", "orders", {}, "unique_by(.o_orderpriority) | map(.o_orderkey) | join(\",\")", "SELECT string_agg(k, ',' ORDER BY p) AS value FROM (SELECT o_orderpriority AS p, min(o_orderkey) AS k FROM orders GROUP BY 1)"),
    "ordered_sort": ("slurp", "nation", {}, "sort_by(.n_regionkey, .n_name) | map(.n_name) | join(\" \")", "SELECT string_agg(n_name, ' ' ORDER BY n_regionkey, n_name) AS value FROM nation"),
    "sort_reversed": ("slurp", "orders", {}, "sort_by(.o_totalprice, .o_orderkey) | reverse | .[:5] | map(.o_orderkey) | join(\",\")", "SELECT string_agg(k, ',' ORDER BY p DESC, k DESC) AS value FROM (SELECT o_orderkey AS k, o_totalprice AS p FROM orders ORDER BY p DESC, k DESC LIMIT 5)"),
    "sort_last": ("slurp", "orders", {}, "sort_by(.o_totalprice, .o_orderkey) | last | {o_orderkey}", "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 1"),
    "group_values": ("slurp", "orders", {}, "group_by(.o_custkey) | map({c: .[0].o_custkey, orders: (map(.o_orderkey) | join(\",\"))})", "SELECT o_custkey AS c, string_agg(o_orderkey, ',' ORDER BY o_orderkey) AS orders FROM orders GROUP BY 1"),
    "group_sizes_max": ("slurp", "orders", {}, "group_by(.o_custkey) | map(length) | max", "SELECT max(n) AS value FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey)"),
    "group_count": ("slurp", "orders", {}, "group_by(.o_custkey) | length", "SELECT count(DISTINCT o_custkey) AS value FROM orders"),
    "having": ("slurp", "orders", {}, "group_by(.o_custkey) | map(select(length > 12) | {c: .[0].o_custkey, n: length})", "SELECT o_custkey AS c, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 12"),
    "limit_rows": ("slurp", "orders", {}, "[limit(5; .[] | select(.o_totalprice > 200000) | .o_orderkey)] | join(\",\")", "SELECT string_agg(k, ',' ORDER BY k) AS value FROM (SELECT o_orderkey AS k FROM orders WHERE o_totalprice > 200000 ORDER BY 1 LIMIT 5)"),
    "skip_rows": ("slurp", "nation", {}, "[skip(20; .[] | .n_name)] | join(\",\")", "SELECT string_agg(n_name, ',' ORDER BY n_nationkey) AS value FROM nation WHERE n_nationkey >= 20"),
    "nth_match": ("slurp", "orders", {}, "nth(3; .[] | select(.o_totalprice > 200000) | .o_orderkey)", "SELECT o_orderkey AS value FROM orders WHERE o_totalprice > 200000 ORDER BY 1 LIMIT 1 OFFSET 3"),
    "first_match": ("slurp", "orders", {}, "first(.[] | select(.o_totalprice > 250000) | .o_orderkey)", "SELECT o_orderkey AS value FROM orders WHERE o_totalprice > 250000 ORDER BY 1 LIMIT 1"),
    "last_match": ("slurp", "orders", {}, "last(.[] | select(.o_totalprice > 250000) | .o_orderkey)", "SELECT max(o_orderkey) AS value FROM orders WHERE o_totalprice > 250000"),
    "isempty_rows": ("slurp", "orders", {}, "{none: isempty(.[] | select(.o_totalprice < 0)), some: isempty(.[]), total: (add(.[].o_orderkey))}", "SELECT count(*) FILTER (o_totalprice < 0) = 0 AS none, count(*) = 0 AS some, sum(o_orderkey)::DOUBLE AS total FROM orders"),
    "join_pairs": ("slurp", "orders", {"c": "customer"}, "INDEX($c[]; .c_custkey) as $i | JOIN($i; .o_custkey | tostring) | map({k: .[0].o_orderkey, s: .[1].c_mktsegment})", "SELECT o_orderkey AS k, c_mktsegment AS s FROM orders LEFT JOIN customer ON o_custkey = c_custkey"),
    "join_stream": ("slurp", "supplier", {"n": "nation"}, "($n | INDEX(.n_nationkey)) as $i | JOIN($i; .[]; .s_nationkey | tostring) | {s: .[0].s_name, n: .[1].n_name}", "SELECT s_name AS s, n_name AS n FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey"),
    "index_self": ("slurp", "nation", {}, "INDEX(.n_nationkey) as $i | JOIN($i; .n_regionkey | tostring) | map({a: .[0].n_name, b: .[1].n_name})", "SELECT a.n_name AS a, b.n_name AS b FROM nation a LEFT JOIN nation b ON a.n_regionkey = b.n_nationkey"),
    "price_ranges": (
        "slurp", "supplier", {"c": "customer"}, ".[] as $s | $c[] as $c1 | select($c1.c_acctbal >= $s.s_acctbal and $c1.c_acctbal < $s.s_acctbal + 10) | {s: $s.s_suppkey, c: $c1.c_custkey}",
        "SELECT s_suppkey AS s, c_custkey AS c FROM supplier JOIN customer ON c_acctbal >= s_acctbal AND c_acctbal < s_acctbal + 10",
    ),
    "definitions": ("each", "lineitem", {}, "def net($rate): .l_extendedprice * (1 - $rate); def cents(f): f * 100 | floor; {l_orderkey, l_linenumber, n: cents(net(.l_discount))}", "SELECT l_orderkey, l_linenumber, floor(l_extendedprice * (1 - l_discount) * 100) AS n FROM lineitem"),
    "patterns": ("each", "nation", {}, ". as {n_name: $n, n_regionkey: $r} | {n: ($n | ascii_downcase), r: $r}", "SELECT lower(n_name) AS n, n_regionkey AS r FROM nation"),
    "array_patterns": ("each", "embeddings", {}, ".embedding as [$a, $b] | {vec_id, s: ($a * $b * 1e6 | round)}", "SELECT vec_id, round(embedding[1]::DOUBLE * embedding[2]::DOUBLE * 1e6) AS s FROM embeddings"),
    "csv_doubles": ("each", "part", {}, "[.p_partkey, .p_retailprice, .p_name] | @csv", "SELECT p_partkey || ',' || regexp_replace(p_retailprice::VARCHAR, '\\.0$', '') || ',\"' || p_name || '\"' AS value FROM part"),
    "tsv_rows": ("each", "part", {}, "[.p_name, .p_retailprice, .p_size] | @tsv", "SELECT p_name || chr(9) || regexp_replace(p_retailprice::VARCHAR, '\\.0$', '') || chr(9) || p_size AS value FROM part"),
    "number_text": ("each", "lineitem", {}, "\"\\(.l_discount)/\\(.l_quantity)/\\(.l_extendedprice)\"", "SELECT regexp_replace(l_discount::VARCHAR, '\\.0$', '') || '/' || regexp_replace(l_quantity::VARCHAR, '\\.0$', '') || '/' || regexp_replace(l_extendedprice::VARCHAR, '\\.0$', '') AS value FROM lineitem"),
    "captures": ("each", "part", {}, ".p_brand | capture(\"(?<name>[A-Za-z]+)#(?<no>[0-9]+)\")", "SELECT regexp_extract(p_brand, '([A-Za-z]+)#([0-9]+)', 1) AS name, regexp_extract(p_brand, '([A-Za-z]+)#([0-9]+)', 2) AS no FROM part WHERE regexp_matches(p_brand, '[A-Za-z]+#[0-9]+')"),
    "replaced_groups": ("each", "part", {}, "{p_partkey, b: (.p_brand | gsub(\"(?<d>[0-9])\"; \"<\\(.d)>\")), c: (.p_type | sub(\"[A-Z]+\"; \"x\"))}", "SELECT p_partkey, regexp_replace(p_brand, '([0-9])', '<\\1>', 'g') AS b, regexp_replace(p_type, '[A-Z]+', 'x') AS c FROM part"),
    "trimmed": ("each", "customer", {}, "{c_custkey, t: (.c_name | trimstr(\"Customer#\")), r: (.c_name | rtrimstr(\"1\"))}", "SELECT c_custkey, CASE WHEN starts_with(c_name, 'Customer#') THEN substr(c_name, 10) ELSE c_name END AS t, CASE WHEN ends_with(c_name, '1') THEN left(c_name, -1) ELSE c_name END AS r FROM customer"),
    "if_empty": ("each", "part", {}, "if .p_size < 10 then {p_partkey, p_size} else empty end", "SELECT p_partkey, p_size FROM part WHERE p_size < 10"),
    "try_paths": ("each", "nation", {}, "{k: .n_nationkey?, m: (.missing.deep? // \"none\")}", "SELECT n_nationkey AS k, 'none' AS m FROM nation"),
    "alternative_update": ("each", "nation", {}, ".n_name += \"!\" | .extra //= .n_regionkey | del(.n_regionkey)", "SELECT n_nationkey, n_name || '!' AS n_name, n_regionkey AS extra FROM nation"),
    "reduce_total": ("slurp", "lineitem", {}, "reduce .[] as $l (0; . + $l.l_quantity)", "SELECT sum(l_quantity) AS value FROM lineitem"),
    "rounding": (
        "each", "customer", {}, "{c_custkey, f: (.c_acctbal / 7 | floor), c: (.c_acctbal / 7 | ceil), t: (.c_acctbal / 7 | trunc), big: (.c_acctbal * 1e200 | floor | . / 1e200 | round)}",
        "SELECT c_custkey, floor(c_acctbal / 7) AS f, ceil(c_acctbal / 7) AS c, trunc(c_acctbal / 7) AS t, round(c_acctbal * 1e200 / 1e200) AS big FROM customer",
    ),
    "fractional_slices": ("each", "part", {}, "{p_partkey, a: .p_name[:2.5], b: .p_name[1.5:4], c: .p_name[-2.5:]}", "SELECT p_partkey, substr(p_name, 1, 3) AS a, substr(p_name, 2, 3) AS b, right(p_name, 3) AS c FROM part"),
}

#: name: (mode, table, program, DuckDB query of the JSON text or None)
KERNEL: dict[str, tuple] = {
    "kernel_walk": ("each", "region", "walk(if type == \"string\" then ascii_downcase else . end) | tojson", "SELECT '\"{\\\"r_regionkey\\\":' || r_regionkey || ',\\\"r_name\\\":\\\"' || lower(r_name) || '\\\"}\"' AS value, NULL::VARCHAR AS error FROM region"),
    "kernel_tostream": (
        "each", "nation", "tostream",
        "SELECT unnest(['[[\"n_nationkey\"],' || n_nationkey || ']', '[[\"n_name\"],\"' || n_name || '\"]', '[[\"n_regionkey\"],' || n_regionkey || ']', '[[\"n_regionkey\"]]']) AS value, NULL::VARCHAR AS error FROM nation",
    ),
    "kernel_paths": ("each", "nation", "[paths]", "SELECT '[[\"n_nationkey\"],[\"n_name\"],[\"n_regionkey\"]]' AS value, NULL::VARCHAR AS error FROM nation"),
    "kernel_recursion": ("each", "region", "def fac: if . <= 1 then 1 else . * (. - 1 | fac) end; .r_regionkey | fac", "SELECT CASE r_regionkey WHEN 2 THEN 2 WHEN 3 THEN 6 WHEN 4 THEN 24 ELSE 1 END::VARCHAR AS value, NULL::VARCHAR AS error FROM region"),
    "kernel_combinations": ("slurp", "region", "[map(.r_regionkey), [1, 2]] | combinations | add", "SELECT (r_regionkey + x)::VARCHAR AS value, NULL::VARCHAR AS error FROM region, (VALUES (1), (2)) t(x)"),
    "kernel_match": ("each", "part", ".p_type | [match(\"[A-Z]+\"; \"g\").length] | length", "SELECT len(regexp_extract_all(p_type, '[A-Z]+'))::VARCHAR AS value, NULL::VARCHAR AS error FROM part"),
    "kernel_errors": ("each", "nation", ".n_nationkey, (.n_name | error)", "SELECT n_nationkey::VARCHAR AS value, NULL::VARCHAR AS error FROM nation UNION ALL SELECT NULL, n_name FROM nation"),
    "kernel_inputs": ("null", "nation", "reduce inputs as $r (0; . + $r.n_nationkey)", "SELECT sum(n_nationkey)::VARCHAR AS value, NULL::VARCHAR AS error FROM nation"),
    "kernel_transpose": ("slurp", "region", "map([.r_regionkey, .r_name]) | transpose | .[0] | add", "SELECT sum(r_regionkey)::VARCHAR AS value, NULL::VARCHAR AS error FROM region"),
    "kernel_entries": ("each", "events", ".props | fromjson | to_entries | map(.key) | join(\",\")", "SELECT '\"k\"' AS value, NULL::VARCHAR AS error FROM events"),
    "kernel_label": ("each", "part", "label $out | foreach range(1; 100) as $i (0; . + $i; if . > 10 then ., break $out else empty end)", "SELECT '15' AS value, NULL::VARCHAR AS error FROM part"),
    "kernel_limit_stream": ("slurp", "nation", "[limit(4; .[] | select(.n_nationkey > 2) | .n_nationkey)] | add", "SELECT '18' AS value, NULL::VARCHAR AS error"),
    "kernel_code_points": ("each", "region", ".r_name | explode | map(. + 1) | implode", "SELECT '\"' || array_to_string(list_transform(string_split(r_name, ''), lambda c: chr(ascii(c) + 1)), '') || '\"' AS value, NULL::VARCHAR AS error FROM region"),
    "kernel_path_edit": ("each", "region", "setpath([\"a\",\"b\"]; .r_regionkey) | delpaths([[\"r_name\"],[\"r_regionkey\"]]) | getpath([\"a\",\"b\"])", "SELECT r_regionkey::VARCHAR AS value, NULL::VARCHAR AS error FROM region"),
    "kernel_try_catch": ("each", "nation", "try (if .n_nationkey % 2 == 0 then error(\"even\") else .n_nationkey end) catch .", "SELECT CASE WHEN n_nationkey % 2 = 0 THEN '\"even\"' ELSE n_nationkey::VARCHAR END AS value, NULL::VARCHAR AS error FROM nation"),
    "kernel_destructure": ("each", "nation", ". as {n_name: $n, n_regionkey: $r} | \"\\($n):\\($r)\"", "SELECT '\"' || n_name || ':' || n_regionkey || '\"' AS value, NULL::VARCHAR AS error FROM nation"),
    "kernel_alternative_patterns": ("slurp", "region", ".[] | [.r_regionkey], {a: .r_regionkey} | . as [$a] ?// {a: $a} | $a", "SELECT r_regionkey::VARCHAR AS value, NULL::VARCHAR AS error FROM region, range(2)"),
    "kernel_loops": ("each", "region", ".r_regionkey | [recurse(if . < 6 then . + 2 else empty end)] + [while(. < 5; . + 1)] + [until(. > 7; . + 3)] + [limit(2; repeat(.))] | add", "WITH r AS (SELECT r_regionkey AS k FROM region) SELECT ((SELECT sum(x) FROM generate_series(k, 7, 2) g(x)) + coalesce((SELECT sum(x) FROM generate_series(k, 4) g(x)), 0) + (SELECT min(x) FROM generate_series(k, 12, 3) g(x) WHERE x > 7) + 2 * k)::BIGINT::VARCHAR AS value, NULL::VARCHAR AS error FROM r"),
    "kernel_event_round_trip": ("each", "nation", "[tostream] | fromstream(.[]) | .n_name", "SELECT '\"' || n_name || '\"' AS value, NULL::VARCHAR AS error FROM nation"),
    "kernel_truncated_events": ("each", "region", "[1 | truncate_stream([[\"a\",0],1],[[\"a\",0]])] | tojson", "SELECT '\"[[[0],1],[[0]]]\"' AS value, NULL::VARCHAR AS error FROM region"),
    "kernel_search_sorted": ("slurp", "nation", "map(.n_nationkey) | sort | bsearch(7), bsearch(7.5)", "SELECT unnest(['7', '-9']) AS value, NULL::VARCHAR AS error"),
    "kernel_times": ("each", "orders", ".o_orderdate | strftime(\"%Y-%m-%d\") | strptime(\"%Y-%m-%d\") | mktime", "SELECT epoch(date_trunc('day', o_orderdate))::BIGINT::VARCHAR AS value, NULL::VARCHAR AS error FROM orders"),
    "kernel_literal_text": ("each", "region", "\"[7.250,123456789012345678901,3E5]\" | fromjson | tojson", "SELECT '\"[7.250,123456789012345678901,3E+5]\"' AS value, NULL::VARCHAR AS error FROM region"),
    "kernel_total_order": ("slurp", "region", "[.[0], \"x\", null, [1], 2, true, false, nan] | sort | map(type) | join(\" \")", "SELECT '\"null boolean boolean number number string array object\"' AS value, NULL::VARCHAR AS error"),
    "kernel_flatten_levels": ("each", "region", "[[.r_regionkey, [1]], [[2]]] | [flatten, flatten(1)] | tojson", "SELECT '\"[[' || r_regionkey || ',1,2],[' || r_regionkey || ',[1],[2]]]\"' AS value, NULL::VARCHAR AS error FROM region"),
    "kernel_base32": ("each", "region", ".r_name | @base32 | @base32d", "SELECT '\"' || r_name || '\"' AS value, NULL::VARCHAR AS error FROM region"),
    "kernel_type_selectors": ("slurp", "region", "[.[0], 1, \"a\", null, [2]] | [(.[] | numbers), (.[] | strings), (.[] | iterables | length)] | tojson", "SELECT '\"[1,\\\"a\\\",2,1]\"' AS value, NULL::VARCHAR AS error"),
    "kernel_getpath": ("each", "nation", "getpath([\"n_name\"]), getpath([\"no\", \"such\"])", "SELECT unnest(['\"' || n_name || '\"', 'null']) AS value, NULL::VARCHAR AS error FROM nation"),
    "kernel_from_entries": ("each", "region", "[{key: .r_name, value: null, v: 1}, {k: \"b\", v: false}, {key: false, value: .r_regionkey}] | from_entries | tojson", "SELECT '\"{\\\"' || r_name || '\\\":null,\\\"b\\\":false,\\\"false\\\":' || r_regionkey || '}\"' AS value, NULL::VARCHAR AS error FROM region"),
    "kernel_with_entries": ("each", "region", "with_entries(.key |= ltrimstr(\"r_\")) | .name", "SELECT '\"' || r_name || '\"' AS value, NULL::VARCHAR AS error FROM region"),
    "kernel_capture_optional": ("each", "part", ".p_brand | capture(\"(?<a>[A-Z])(?<b>x)?\") | [.a, .b] | tojson", "SELECT '\"[\\\"' || regexp_extract(p_brand, '[A-Z]') || '\\\",null]\"' AS value, NULL::VARCHAR AS error FROM part"),
    "kernel_scan_groups": ("each", "part", "[.p_type | scan(\"([A-Z])[A-Z]+\") | .[0]] | join(\"\")", "SELECT '\"' || array_to_string(regexp_extract_all(p_type, '([A-Z])[A-Z]+', 1), '') || '\"' AS value, NULL::VARCHAR AS error FROM part"),
    "kernel_sub_twice": ("each", "region", "\"aXbX\" | [sub(\"X\"; \"1\", \"2\")] | join(\" \")", "SELECT '\"a1bX a2bX\"' AS value, NULL::VARCHAR AS error FROM region"),
    "kernel_end_matches": ("each", "region", "\"aa\" | [match(\"a*\"; \"g\").length], gsub(\"a*\"; \"x\"), [scan(\"a*\")]", "SELECT unnest(['[2]', '\"x\"', '[\"aa\"]']) AS value, NULL::VARCHAR AS error FROM region"),
    "kernel_tsv": ("each", "region", "[\"a\\tb\", .r_regionkey, null, true] | @tsv", "SELECT '\"a\\\\tb\\t' || r_regionkey || '\\t\\ttrue\"' AS value, NULL::VARCHAR AS error FROM region"),
    "kernel_decoded": ("each", "nation", "(.n_name | @uri | @urid), (.n_name | @base64 | @base64d)", "SELECT unnest(['\"' || n_name || '\"', '\"' || n_name || '\"']) AS value, NULL::VARCHAR AS error FROM nation"),
    "kernel_join_pairs": ("slurp", "nation", "INDEX(.n_nationkey) as $i | JOIN($i; .n_regionkey | tostring) | map(.[1].n_nationkey) | add", "SELECT sum(n_regionkey)::VARCHAR AS value, NULL::VARCHAR AS error FROM nation"),
    "kernel_join_stream": ("slurp", "nation", "INDEX(.n_nationkey) as $i | [JOIN($i; .[]; .n_regionkey | tostring) | .[1].n_nationkey] | length", "SELECT count(*)::VARCHAR AS value, NULL::VARCHAR AS error FROM nation"),
    "kernel_isempty": ("each", "nation", "[isempty(.n_nationkey | select(. > 20)), isempty(empty)]", "SELECT '[' || (n_nationkey <= 20) || ',true]' AS value, NULL::VARCHAR AS error FROM nation"),
    "kernel_last_skip": ("each", "region", "[last(range(.r_regionkey + 1)), skip(2; range(.r_regionkey + 3)), last(empty)] | map(tojson) | join(\" \")" , "SELECT '\"' || r_regionkey || ' ' || array_to_string(generate_series(2, r_regionkey + 2), ' ') || ' null\"' AS value, NULL::VARCHAR AS error FROM region"),
    "kernel_keys": ("each", "nation", "[keys[0], keys_unsorted[0], (to_entries | length), has(\"n_name\"), (\"no\" | in({no: 1}))] | tojson", "SELECT '\"[\\\"n_name\\\",\\\"n_nationkey\\\",3,true,true]\"' AS value, NULL::VARCHAR AS error FROM nation"),
    "kernel_recurse_paths": ("each", "nation", "([path(..)] | length), ([..] | length), ([paths(type == \"number\")] | length)", "SELECT unnest(['4', '4', '2']) AS value, NULL::VARCHAR AS error FROM nation"),
    "kernel_update_forms": ("each", "region", "{a: .r_regionkey, b: null} | .a -= 1 | .a *= 3 | .a /= 3 | .a %= 2 | .b //= 7 | map_values(. + 1) | tojson", "SELECT '\"{\\\"a\\\":' || ((r_regionkey - 1) % 2 + 1) || ',\\\"b\\\":8}\"' AS value, NULL::VARCHAR AS error FROM region"),
    "kernel_containment": ("each", "nation", "[.n_name, .n_nationkey] | [contains([\"A\"]), inside([.[], 5]), (indices(.[1]) | length)] | tojson", "SELECT '\"[' || contains(n_name, 'A') || ',true,1]\"' AS value, NULL::VARCHAR AS error FROM nation"),
    "kernel_add_forms": ("slurp", "nation", "add(.[].n_nationkey), (map(.n_nationkey) | add), first(.[].n_nationkey), nth(2; .[].n_nationkey), (map({n_name}) | add | length)", "SELECT unnest([sum(n_nationkey)::VARCHAR, sum(n_nationkey)::VARCHAR, '0', '2', '1']) AS value, NULL::VARCHAR AS error FROM nation"),
    "kernel_number_kinds": ("each", "region", "[.r_regionkey, nan, infinite, 1e-320] | [([.[] | finites] | length), ([.[] | normals] | length), (.[1] | isnan), (.[2] | isinfinite, isfinite), (.[0] | isnormal, abs)] | tojson", "SELECT '\"[2,' || (CASE WHEN r_regionkey > 0 THEN 1 ELSE 0 END) || ',true,true,false,' || (r_regionkey > 0) || ',' || r_regionkey || ']\"' AS value, NULL::VARCHAR AS error FROM region"),
    "kernel_pair_math": ("each", "nation", "[atan2(.n_nationkey; 2), fmod(.n_nationkey; 3), hypot(.n_nationkey; 4), fmin(.n_nationkey; 9), fmax(.n_nationkey; 9), copysign(.n_nationkey; -1)] | map(. * 1e6 | round) | add", "SELECT (round(atan2(n_nationkey, 2) * 1e6) + round((n_nationkey % 3) * 1e6) + round(sqrt(n_nationkey * n_nationkey + 16) * 1e6) + least(n_nationkey, 9) * 1e6 + greatest(n_nationkey, 9) * 1e6 - n_nationkey * 1e6)::BIGINT::VARCHAR AS value, NULL::VARCHAR AS error FROM nation"),
    "kernel_inverse_math": ("each", "nation", "(.n_nationkey + 1) / 30 | [asin, acos, sinh, cosh, tanh, asinh, atanh, log, log2, log1p, expm1, exp2, exp10, cos, tan, (. + 1 | acosh)] | map(. * 1e6 | round) | add", "WITH t AS (SELECT (n_nationkey + 1) / 30 AS x FROM nation) SELECT (round(asin(x) * 1e6) + round(acos(x) * 1e6) + round(sinh(x) * 1e6) + round(cosh(x) * 1e6) + round(tanh(x) * 1e6) + round(asinh(x) * 1e6) + round(atanh(x) * 1e6) + round(ln(x) * 1e6) + round(log2(x) * 1e6) + round(ln(1 + x) * 1e6) + round((exp(x) - 1) * 1e6) + round(pow(2, x) * 1e6) + round(pow(10, x) * 1e6) + round(cos(x) * 1e6) + round(tan(x) * 1e6) + round(acosh(x + 1) * 1e6))::BIGINT::VARCHAR AS value, NULL::VARCHAR AS error FROM t"),
    "kernel_text_forms": ("each", "nation", "[(.n_nationkey | tostring), (.n_name | tojson), ([.n_nationkey] | @json), (.n_nationkey | @text), (.n_name | test(\"a\"; \"i\")), (.n_name | ascii_downcase | ascii_upcase == .)] | length, $__loc__.line, (now > 0)", "SELECT unnest(['6', '1', 'true']) AS value, NULL::VARCHAR AS error FROM nation"),
    "kernel_iso_dates": ("each", "orders", ".o_orderdate | todate | [fromdate, (strptime(\"%Y-%m-%dT%H:%M:%SZ\") | mktime)] | .[0] == .[1], .[0]", "SELECT unnest(['true', epoch(o_orderdate)::BIGINT::VARCHAR]) AS value, NULL::VARCHAR AS error FROM orders"),
    "kernel_local_times": ("each", "nation", "(.n_nationkey * 86400 | localtime | mktime) - (.n_nationkey * 86400 | gmtime | mktime) | type", "SELECT '\"number\"' AS value, NULL::VARCHAR AS error FROM nation"),
    "kernel_bad_records": ("each", "nation", "if .n_nationkey % 5 == 0 then [1] | transpose else .n_nationkey end", "SELECT CASE WHEN n_nationkey % 5 <> 0 THEN n_nationkey::VARCHAR END AS value, CASE WHEN n_nationkey % 5 = 0 THEN 'Cannot index number with number' END AS error FROM nation"),
    "kernel_deep_recursion": ("each", "region", ".r_regionkey | [recurse(if . < 3000 then . + 1 else empty end)] | length", "SELECT (3001 - r_regionkey)::VARCHAR AS value, NULL::VARCHAR AS error FROM region"),
    "kernel_scopes": ("each", "region", "[.r_regionkey, def f: 2; f | . + 1] | tojson", "SELECT '\"[' || r_regionkey || ',3]\"' AS value, NULL::VARCHAR AS error FROM region"),
    "kernel_fractions": ("each", "region", "[10, 20, 30] | [.[-1.5], .[-0.5], .[1.9], (.[0.5:1.5] | length)] | tojson", "SELECT '\"[30,10,20,2]\"' AS value, NULL::VARCHAR AS error FROM region"),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _native(entry: tuple) -> Callable[[SparkSession, str], DataFrame]:
    mode, name, side, program, _ = entry

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return run(spark, table(spark, sf_dir, name), program, mode, tables={k: table(spark, sf_dir, t) for k, t in side.items()}, native=True)

    return query


def _kernel(entry: tuple) -> Callable[[SparkSession, str], DataFrame]:
    mode, name, program, _ = entry

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return run(spark, table(spark, sf_dir, name), program, mode, native=False).select("value", F.col("error"))

    return query


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: _native(e) for k, e in NATIVE.items()} | {k: _kernel(e) for k, e in KERNEL.items()}


def oracle_sql() -> dict[str, str]:
    return {k: e[-1] for k, e in (NATIVE | KERNEL).items() if e[-1]}
