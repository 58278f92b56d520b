"""SPARQL over the tables: scans, joins, aggregates, modifiers and functions."""

from __future__ import annotations

from .catalog import FLAGSHIP, add, ask, engine

ask("bgp_star_join", FLAGSHIP, "SELECT n_name AS nation, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'EUROPE' GROUP BY 1")
ask("scan_statement_pattern", 'SELECT ?c ?b WHERE { ?c :c_acctbal ?b ; :c_mktsegment "BUILDING" }', "SELECT 'urn:triloom:customer/' || c_custkey AS c, c_acctbal AS b FROM customer WHERE c_mktsegment = 'BUILDING'")
ask("scan_constant_subject", "SELECT ?p ?o WHERE { <urn:triloom:nation/3> ?p ?o FILTER(isLiteral(?o)) }", "SELECT 'urn:triloom:t#n_nationkey' AS p, n_nationkey::VARCHAR AS o FROM nation WHERE n_nationkey = 3 UNION ALL SELECT 'urn:triloom:t#n_name', n_name FROM nation WHERE n_nationkey = 3 UNION ALL SELECT 'urn:triloom:t#n_regionkey', n_regionkey::VARCHAR FROM nation WHERE n_nationkey = 3")
ask("scan_range_on_object", "SELECT ?o ?t WHERE { ?o :o_totalprice ?t FILTER(?t >= 100000 && ?t < 150000) }", "SELECT 'urn:triloom:orders/' || o_orderkey AS o, o_totalprice AS t FROM orders WHERE o_totalprice >= 100000 AND o_totalprice < 150000")
ask("scan_distinct_terms", "SELECT DISTINCT ?s WHERE { ?o :o_orderstatus ?s }", "SELECT DISTINCT o_orderstatus AS s FROM orders")
ask("scan_fast_range_count", "SELECT (COUNT(*) AS ?n) WHERE { ?l :l_quantity ?q }", "SELECT count(*) AS n FROM lineitem")
ask("scan_class", "SELECT (COUNT(?x) AS ?n) WHERE { ?x a :Supplier }", "SELECT count(*) AS n FROM supplier")
ask("scan_same_variable", "SELECT ?n WHERE { ?n :n_nationkey ?k ; :n_nationkey ?k }", "SELECT 'urn:triloom:nation/' || n_nationkey AS n FROM nation")
ask("scan_variable_predicate", "SELECT ?p (COUNT(*) AS ?n) WHERE { ?s ?p ?o . ?s a :Region } GROUP BY ?p", "SELECT 'urn:triloom:t#r_regionkey' AS p, count(*) AS n FROM region UNION ALL SELECT 'urn:triloom:t#r_name', count(*) FROM region UNION ALL SELECT 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type', count(*) FROM region")
ask("join_part_line_supplier", "SELECT ?brand (SUM(?q) AS ?quantity) (COUNT(*) AS ?n) WHERE { ?l :l_part ?p ; :l_supplier ?s ; :l_quantity ?q . ?p :p_brand ?brand ; :p_size ?z . ?s :s_acctbal ?b FILTER(?z > 25 && ?b > 0) } GROUP BY ?brand", "SELECT p_brand AS brand, sum(l_quantity) AS quantity, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey WHERE p_size > 25 AND s_acctbal > 0 GROUP BY 1")
ask("join_chain", "SELECT ?r (COUNT(*) AS ?n) WHERE { ?l :l_order/:o_customer/:c_nation/:n_region/:r_name ?r } GROUP BY ?r", "SELECT r_name AS r, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
ask("join_optional", "SELECT ?c ?o WHERE { ?c a :Customer OPTIONAL { ?o :o_customer ?c ; :o_totalprice ?t FILTER(?t > 400000) } }", "SELECT 'urn:triloom:customer/' || c_custkey AS c, 'urn:triloom:orders/' || o_orderkey AS o FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 400000")
ask("join_optional_filter_outer", "SELECT ?c (COUNT(?o) AS ?n) WHERE { ?c :c_acctbal ?b OPTIONAL { ?o :o_customer ?c ; :o_totalprice ?t FILTER(?t > ?b * 20) } } GROUP BY ?c", "SELECT 'urn:triloom:customer/' || c_custkey AS c, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > c_acctbal * 20 GROUP BY c_custkey")
ask("join_union", "SELECT ?n ?kind WHERE { { ?c :c_nation ?n BIND('customer' AS ?kind) } UNION { ?s :s_nation ?n BIND('supplier' AS ?kind) } }", "SELECT 'urn:triloom:nation/' || c_nationkey AS n, 'customer' AS kind FROM customer UNION ALL SELECT 'urn:triloom:nation/' || s_nationkey, 'supplier' FROM supplier")
ask("join_minus", "SELECT ?n WHERE { ?n a :Nation MINUS { ?s :s_nation ?n ; :s_acctbal ?b FILTER(?b > 9000) } }", "SELECT 'urn:triloom:nation/' || n_nationkey AS n FROM nation WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal > 9000)")
ask("join_minus_disjoint", "SELECT ?n WHERE { ?n a :Nation MINUS { ?x :r_name ?y } }", "SELECT 'urn:triloom:nation/' || n_nationkey AS n FROM nation")
ask("join_exists", "SELECT ?c WHERE { ?c a :Customer FILTER EXISTS { ?o :o_customer ?c ; :o_orderstatus 'F' } }", "SELECT 'urn:triloom:customer/' || c_custkey AS c FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
ask("join_not_exists", "SELECT ?c WHERE { ?c a :Customer FILTER NOT EXISTS { ?o :o_customer ?c } }", "SELECT 'urn:triloom:customer/' || c_custkey AS c FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
ask("join_exists_correlated", "SELECT ?c WHERE { ?c :c_acctbal ?b FILTER EXISTS { ?o :o_customer ?c ; :o_totalprice ?t FILTER(?t > ?b * 50) } }", "SELECT 'urn:triloom:customer/' || c_custkey AS c FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > c_acctbal * 50)")
ask("join_exists_in_expression", "SELECT ?n WHERE { ?n :n_nationkey ?k FILTER(?k < 5 || EXISTS { ?s :s_nation ?n ; :s_acctbal ?b FILTER(?b > 9500) }) }", "SELECT 'urn:triloom:nation/' || n_nationkey AS n FROM nation WHERE n_nationkey < 5 OR EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal > 9500)")
ask("join_values", "SELECT ?s (COUNT(?c) AS ?n) WHERE { VALUES ?s { 'BUILDING' 'MACHINERY' } ?c :c_mktsegment ?s } GROUP BY ?s", "SELECT c_mktsegment AS s, count(*) AS n FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') GROUP BY 1")
ask("join_values_undef", "SELECT ?st ?pr (COUNT(*) AS ?n) WHERE { ?o :o_orderstatus ?st ; :o_orderpriority ?pr VALUES (?st ?pr) { ('F' UNDEF) (UNDEF '1-URGENT') } } GROUP BY ?st ?pr", "SELECT o_orderstatus AS st, o_orderpriority AS pr, sum((o_orderstatus = 'F')::INT + (o_orderpriority = '1-URGENT')::INT)::BIGINT AS n FROM orders WHERE o_orderstatus = 'F' OR o_orderpriority = '1-URGENT' GROUP BY 1, 2")
ask("join_subselect", "SELECT ?c ?best WHERE { { SELECT ?c (MAX(?t) AS ?best) WHERE { ?o :o_customer ?c ; :o_totalprice ?t } GROUP BY ?c } ?c :c_mktsegment 'AUTOMOBILE' }", "SELECT 'urn:triloom:customer/' || c_custkey AS c, max(o_totalprice) AS best FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_mktsegment = 'AUTOMOBILE' GROUP BY c_custkey")
ask("join_named_subquery", "SELECT ?c ?n WITH { SELECT ?c (COUNT(?o) AS ?n) WHERE { ?o :o_customer ?c } GROUP BY ?c } AS %orders WHERE { INCLUDE %orders FILTER(?n > 12) }", "SELECT 'urn:triloom:customer/' || o_custkey AS c, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12")
ask("join_unbound_compatible", "SELECT ?n ?x WHERE { ?n a :Nation OPTIONAL { ?x :s_nation ?n ; :s_acctbal ?b FILTER(?b > 9000) } { ?x a :Supplier } }", "SELECT 'urn:triloom:nation/' || n_nationkey AS n, 'urn:triloom:supplier/' || s.s_suppkey AS x FROM nation JOIN supplier s ON s.s_nationkey = n_nationkey AND s.s_acctbal > 9000 UNION ALL SELECT 'urn:triloom:nation/' || n_nationkey, 'urn:triloom:supplier/' || s_suppkey FROM nation, supplier WHERE NOT EXISTS (SELECT 1 FROM supplier t WHERE t.s_nationkey = n_nationkey AND t.s_acctbal > 9000)")
ask("join_cross_product", "SELECT ?a ?b WHERE { ?x :r_name ?a . ?y :r_name ?b FILTER(?a < ?b) }", "SELECT a.r_name AS a, b.r_name AS b FROM region a, region b WHERE a.r_name < b.r_name")
ask("join_theta", "SELECT (COUNT(*) AS ?n) WHERE { ?s :s_nation ?k ; :s_acctbal ?a . ?c :c_nation ?k ; :c_acctbal ?b FILTER(?a < ?b) }", "SELECT count(*) AS n FROM supplier JOIN customer ON s_nationkey = c_nationkey WHERE s_acctbal < c_acctbal")
ask("join_hints", "SELECT ?p (COUNT(*) AS ?n) WHERE { hint:Query hint:optimizer 'None' . ?o :o_orderpriority ?p . ?l :l_order ?o . hint:Prior hint:hashJoin true } GROUP BY ?p", "SELECT o_orderpriority AS p, count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")

ask("agg_all", "SELECT ?f ?s (SUM(?q) AS ?sum_qty) (COUNT(*) AS ?n) (MIN(?q) AS ?least) (MAX(?q) AS ?most) (COUNT(DISTINCT ?p) AS ?parts) WHERE { ?l :l_returnflag ?f ; :l_linestatus ?s ; :l_quantity ?q ; :l_partkey ?p } GROUP BY ?f ?s", "SELECT l_returnflag AS f, l_linestatus AS s, sum(l_quantity) AS sum_qty, count(*) AS n, min(l_quantity) AS least, max(l_quantity) AS most, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY 1, 2")
ask("agg_avg", "SELECT ?f (ROUND(AVG(?p)) AS ?mean) WHERE { ?l :l_returnflag ?f ; :l_extendedprice ?p } GROUP BY ?f", "SELECT l_returnflag AS f, floor(avg(l_extendedprice) + 0.5) AS mean FROM lineitem GROUP BY 1")
ask("agg_having", "SELECT ?c (COUNT(?o) AS ?n) WHERE { ?o :o_customer ?c } GROUP BY ?c HAVING (COUNT(?o) > 10)", "SELECT 'urn:triloom:customer/' || o_custkey AS c, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 10")
ask("agg_group_concat", "SELECT ?r (GROUP_CONCAT(?n; SEPARATOR='|') AS ?names) WHERE { ?x :n_region ?y ; :n_name ?n . ?y :r_name ?r } GROUP BY ?r", "SELECT r_name AS r, string_agg(n_name, '|' ORDER BY n_name) AS names FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
ask("agg_expression_key", "SELECT ?y (COUNT(*) AS ?n) WHERE { ?o :o_orderdate ?d } GROUP BY (YEAR(?d) AS ?y)", "SELECT year(o_orderdate)::BIGINT AS y, count(*) AS n FROM orders GROUP BY 1")
ask("agg_distinct_sum", "SELECT ?t (SUM(DISTINCT ?z) AS ?sizes) WHERE { ?p :p_type ?t ; :p_size ?z } GROUP BY ?t", "SELECT p_type AS t, sum(DISTINCT p_size)::BIGINT AS sizes FROM part GROUP BY 1")
ask("agg_empty", "SELECT (COUNT(*) AS ?n) (SUM(?k) AS ?s) WHERE { ?x :r_regionkey ?k FILTER(?k > 99) }", "SELECT count(*) AS n, 0::BIGINT AS s FROM region WHERE r_regionkey > 99")
ask("agg_over_expression", "SELECT ?f (ROUND(SUM(?p * (1 - ?d)) / 1000) AS ?revenue) WHERE { ?l :l_returnflag ?f ; :l_extendedprice ?p ; :l_discount ?d } GROUP BY ?f", "SELECT l_returnflag AS f, floor(sum(l_extendedprice * (1 - l_discount)) / 1000 + 0.5) AS revenue FROM lineitem GROUP BY 1")
ask("agg_count_distinct_all", "SELECT (COUNT(DISTINCT *) AS ?n) WHERE { { SELECT ?s ?p WHERE { ?o :o_orderstatus ?s ; :o_orderpriority ?p } } }", "SELECT count(*) AS n FROM (SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders)")
ask("agg_order_by_aggregate", "SELECT ?s WHERE { ?c :c_mktsegment ?s ; :c_acctbal ?b } GROUP BY ?s ORDER BY DESC(SUM(?b)) LIMIT 2", "SELECT c_mktsegment AS s FROM customer GROUP BY 1 ORDER BY sum(c_acctbal) DESC LIMIT 2")

ask("mod_order_slice", "SELECT ?o ?t WHERE { ?o :o_totalprice ?t } ORDER BY DESC(?t) ?o LIMIT 20 OFFSET 5", "SELECT 'urn:triloom:orders/' || o_orderkey AS o, o_totalprice AS t FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 5")
ask("mod_distinct_order", "SELECT DISTINCT ?s ?p WHERE { ?o :o_orderstatus ?s ; :o_orderpriority ?p } ORDER BY ?p DESC(?s)", "SELECT DISTINCT o_orderstatus AS s, o_orderpriority AS p FROM orders")
ask("mod_reduced", "SELECT REDUCED ?s WHERE { ?c :c_mktsegment ?s }", "SELECT DISTINCT c_mktsegment AS s FROM customer")
ask("mod_bind", "SELECT ?l ?net WHERE { ?l :l_extendedprice ?p ; :l_discount ?d ; :l_tax ?t BIND(?p * (1 - ?d) AS ?x) BIND(FLOOR(?x * (1 + ?t)) AS ?net) FILTER(?net > 90000) }", "SELECT 'urn:triloom:lineitem/' || l_orderkey || '-' || l_linenumber AS l, floor(l_extendedprice * (1 - l_discount) * (1 + l_tax)) AS net FROM lineitem WHERE floor(l_extendedprice * (1 - l_discount) * (1 + l_tax)) > 90000")
ask("mod_top_per_group", "SELECT ?s ?c ?b WHERE { ?c :c_mktsegment ?s ; :c_acctbal ?b { SELECT ?s (MAX(?x) AS ?b) WHERE { ?y :c_mktsegment ?s ; :c_acctbal ?x } GROUP BY ?s } }", "SELECT c_mktsegment AS s, 'urn:triloom:customer/' || c_custkey AS c, c_acctbal AS b FROM customer WHERE (c_mktsegment, c_acctbal) IN (SELECT c_mktsegment, max(c_acctbal) FROM customer GROUP BY 1)")

ask("fn_strings", "SELECT ?p (STRLEN(?n) AS ?len) (UCASE(?n) AS ?up) (LCASE(?n) AS ?low) (SUBSTR(?n, 2, 4) AS ?sub) (CONCAT(?n, '-', ?b) AS ?both) WHERE { ?p :p_name ?n ; :p_brand ?b }", "SELECT 'urn:triloom:part/' || p_partkey AS p, length(p_name)::BIGINT AS len, upper(p_name) AS up, lower(p_name) AS low, substr(p_name, 2, 4) AS sub, p_name || '-' || p_brand AS both FROM part")
ask("fn_string_tests", "SELECT ?p WHERE { ?p :p_name ?n ; :p_type ?t FILTER(CONTAINS(?n, '1') && (STRSTARTS(?t, 'STANDARD') || STRENDS(?t, 'STEEL'))) }", "SELECT 'urn:triloom:part/' || p_partkey AS p FROM part WHERE contains(p_name, '1') AND (starts_with(p_type, 'STANDARD') OR ends_with(p_type, 'STEEL'))")
ask("fn_before_after", "SELECT ?o (STRBEFORE(?p, '-') AS ?a) (STRAFTER(?p, '-') AS ?b) (STRAFTER(?p, '#') AS ?none) WHERE { ?o :o_orderpriority ?p }", "SELECT 'urn:triloom:orders/' || o_orderkey AS o, split_part(o_orderpriority, '-', 1) AS a, substr(o_orderpriority, strpos(o_orderpriority, '-') + 1) AS b, '' AS none FROM orders")
ask("fn_regex_replace", "SELECT ?n (REPLACE(?n, '[aeiou]', '*', 'i') AS ?r) WHERE { ?x :n_name ?n FILTER(REGEX(?n, '^n.*1', 'i')) }", "SELECT n_name AS n, regexp_replace(n_name, '[aeiou]', '*', 'gi') AS r FROM nation WHERE regexp_matches(n_name, '^n.*1', 'i')")
ask("fn_digests", "SELECT ?n (MD5(?n) AS ?m) (SHA1(?n) AS ?s1) (SHA256(?n) AS ?s2) WHERE { ?x :n_name ?n }", "SELECT n_name AS n, md5(n_name) AS m, sha1(n_name) AS s1, sha256(n_name) AS s2 FROM nation")
ask("fn_encode", "SELECT ?t (ENCODE_FOR_URI(?t) AS ?e) WHERE { { SELECT DISTINCT ?t WHERE { ?p :p_type ?t } } }", "SELECT DISTINCT p_type AS t, url_encode(p_type) AS e FROM part")
ask("fn_numeric", "SELECT ?c (ABS(?b) AS ?a) (CEIL(?b) AS ?c1) (FLOOR(?b) AS ?f) (ROUND(?b) AS ?r) (?b / 4 AS ?q) WHERE { ?c :c_acctbal ?b }", "SELECT 'urn:triloom:customer/' || c_custkey AS c, abs(c_acctbal) AS a, ceil(c_acctbal) AS c1, floor(c_acctbal) AS f, floor(c_acctbal + 0.5) AS r, c_acctbal / 4 AS q FROM customer")
ask("fn_dates", "SELECT ?o (YEAR(?d) AS ?y) (MONTH(?d) AS ?m) (DAY(?d) AS ?k) (HOURS(?d) AS ?h) (MINUTES(?d) AS ?i) WHERE { ?o :o_orderdate ?d }", "SELECT 'urn:triloom:orders/' || o_orderkey AS o, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS k, hour(o_orderdate) AS h, minute(o_orderdate) AS i FROM orders")
ask("fn_conditional", "SELECT ?c (IF(?b > 5000, 'high', IF(?b > 0, 'mid', 'low')) AS ?band) (COALESCE(?zz, ?b) AS ?first) WHERE { ?c :c_acctbal ?b }", "SELECT 'urn:triloom:customer/' || c_custkey AS c, CASE WHEN c_acctbal > 5000 THEN 'high' WHEN c_acctbal > 0 THEN 'mid' ELSE 'low' END AS band, CASE WHEN c_acctbal IS NULL THEN NULL ELSE c_acctbal::DOUBLE END AS first FROM customer")
ask("fn_in", "SELECT ?p WHERE { ?p :p_size ?z ; :p_brand ?b FILTER(?z IN (1, 3, 5) && ?b NOT IN ('Brand#11', 'Brand#12')) }", "SELECT 'urn:triloom:part/' || p_partkey AS p FROM part WHERE p_size IN (1, 3, 5) AND p_brand NOT IN ('Brand#11', 'Brand#12')")
ask("fn_bound", "SELECT ?c WHERE { ?c a :Customer OPTIONAL { ?o :o_customer ?c } FILTER(!BOUND(?o)) }", "SELECT 'urn:triloom:customer/' || c_custkey AS c FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
ask("fn_terms", "SELECT ?x (STR(?x) AS ?s) (DATATYPE(?k) AS ?d) (isIRI(?x) AS ?i) (isLiteral(?k) AS ?l) (isNumeric(?n) AS ?num) (LANG(?n) AS ?g) (IRI(CONCAT('urn:x:', ?n)) AS ?u) WHERE { ?x :n_nationkey ?k ; :n_name ?n }", "SELECT 'urn:triloom:nation/' || n_nationkey AS x, 'urn:triloom:nation/' || n_nationkey AS s, 'http://www.w3.org/2001/XMLSchema#integer' AS d, true AS i, true AS l, false AS num, '' AS g, 'urn:x:' || n_name AS u FROM nation")
ask("fn_casts", "SELECT ?x (xsd:string(?k) AS ?s) (xsd:integer(?b) AS ?i) (xsd:double(?k) AS ?d) (xsd:boolean(?k) AS ?t) WHERE { ?x :s_suppkey ?k ; :s_acctbal ?b }", "SELECT 'urn:triloom:supplier/' || s_suppkey AS x, s_suppkey::VARCHAR AS s, trunc(s_acctbal)::BIGINT AS i, s_suppkey::DOUBLE AS d, s_suppkey <> 0 AS t FROM supplier")
ask("fn_same_term", "SELECT (COUNT(*) AS ?n) WHERE { ?c :c_nation ?a . ?s :s_nation ?b FILTER(sameTerm(?a, ?b)) }", "SELECT count(*) AS n FROM customer JOIN supplier ON c_nationkey = s_nationkey")

ask("path_sequence_inverse", "SELECT ?r ?c WHERE { ?r ^:n_region/^:c_nation ?c ; :r_name 'ASIA' }", "SELECT 'urn:triloom:region/' || r_regionkey AS r, 'urn:triloom:customer/' || c_custkey AS c FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey WHERE r_name = 'ASIA'")
ask("path_alternative", "SELECT ?n (COUNT(?x) AS ?m) WHERE { ?x :c_nation|:s_nation ?n } GROUP BY ?n", "SELECT 'urn:triloom:nation/' || k AS n, count(*) AS m FROM (SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier) GROUP BY k")
ask("path_optional_step", "SELECT ?x WHERE { <urn:triloom:nation/1> :n_region? ?x }", "SELECT 'urn:triloom:nation/1' AS x UNION SELECT 'urn:triloom:region/' || n_regionkey FROM nation WHERE n_nationkey = 1")
ask("path_negated_set", "SELECT (COUNT(*) AS ?n) WHERE { ?x !(:n_name|:n_regionkey|rdf:type) ?y . ?x a :Nation }", "SELECT 2 * count(*) AS n FROM nation")
ask("path_closure", "SELECT ?x WHERE { <urn:triloom:customer/7> (:c_nation|:n_region)+ ?x }", "SELECT 'urn:triloom:nation/' || c_nationkey AS x FROM customer WHERE c_custkey = 7 UNION SELECT 'urn:triloom:region/' || n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey = 7")

add("form_construct", lambda spark, d: engine(spark, d).query("CONSTRUCT { ?r :has ?n } WHERE { ?n :n_region ?r }").selectExpr("s.lex AS s", "p.lex AS p", "o.lex AS o"), "SELECT 'urn:triloom:region/' || n_regionkey AS s, 'urn:triloom:t#has' AS p, 'urn:triloom:nation/' || n_nationkey AS o FROM nation")
add("form_describe", lambda spark, d: engine(spark, d).query("DESCRIBE <urn:triloom:region/2>").selectExpr("s.lex AS s", "p.lex AS p", "o.lex AS o"), "SELECT 'urn:triloom:region/2' AS s, 'urn:triloom:t#r_regionkey' AS p, '2' AS o UNION ALL SELECT 'urn:triloom:region/2', 'urn:triloom:t#r_name', r_name FROM region WHERE r_regionkey = 2 UNION ALL SELECT 'urn:triloom:region/2', 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type', 'urn:triloom:t#Region' UNION ALL SELECT 'urn:triloom:nation/' || n_nationkey, 'urn:triloom:t#n_region', 'urn:triloom:region/2' FROM nation WHERE n_regionkey = 2")
add("form_ask", lambda spark, d: spark.range(1).selectExpr(f"{str(engine(spark, d).query('ASK { ?c :c_acctbal ?b FILTER(?b > 9900) }')).lower()} AS found"), "SELECT count(*) > 0 AS found FROM customer WHERE c_acctbal > 9900")
