"""The queries in SQL, written from the definitions of the results."""

from __future__ import annotations

TEXT = "SELECT doc_id AS id, coalesce(text, '') AS text FROM documents"


def images(source: str = TEXT) -> str:
    """CTE img (id, w, h) and px (id, w, h, x, y, v) of texts' bytes; source: id, text."""
    return f"""
src AS ({source}),
img AS (SELECT id, octet_length(encode(text)) AS n, greatest(1, ceil(sqrt(octet_length(encode(text)))))::BIGINT AS w,
               regexp_extract_all(hex(encode(text)), '..') AS hx FROM src),
im AS (SELECT *, greatest(1, ceil(n / w))::BIGINT AS h FROM img),
raw AS (SELECT id, w, h, unnest(hx) AS b, unnest(range(len(hx))) AS i FROM im),
px AS (SELECT id, w, h, i % w AS x, i // w AS y, ('0x' || b)::INT AS v FROM raw)"""


def _cell(axis: str, size: str, n: int) -> str:
    return f"len(list_filter(range(1, {n}), lambda d: floor(d * ({size}::DOUBLE / {n})) <= {axis}))"


def _span(size: str, n: int, c: str) -> str:
    r = f"({size}::DOUBLE / {n})"
    return f"(floor(least(({c} + 1) * {r}, {size})) - floor({c} * {r}))::BIGINT"


def _end(size: str, n: int) -> str:
    return f"floor(least({n} * ({size}::DOUBLE / {n}), {size}))"


def resized(width: int, height: int, name: str = "g", px: str = "px", im: str = "im") -> str:
    """CTE ``name`` (id, p): the box-filtered grid of each image."""
    return f"""
{name}_s AS (SELECT id, {_cell("x", "w", width)} AS cx, {_cell("y", "h", height)} AS cy, sum(v) AS s FROM {px}
             WHERE x < {_end("w", width)} AND y < {_end("h", height)} GROUP BY ALL),
{name}_c AS (SELECT id, w, h, cx, cy FROM {im}, range({width}) AS a(cx), range({height}) AS b(cy)),
{name} AS (SELECT id, list(CAST(coalesce(s, 0) // greatest(1, {_span("w", width, "cx")} * {_span("h", height, "cy")}) AS INT) ORDER BY cy, cx) AS p
           FROM {name}_c LEFT JOIN {name}_s USING (id, cx, cy) GROUP BY id)"""


def pixels_of(grid: str, width: int, height: int, name: str) -> str:
    """CTE ``name``_px and ``name``_im of a grid, as images again."""
    return f"""
{name}_px AS (SELECT id, {width} AS w, {height} AS h, i % {width} AS x, i // {width} AS y, v
              FROM (SELECT id, unnest(p) AS v, unnest(range({width * height})) AS i FROM {grid})),
{name}_im AS (SELECT id, {width} AS w, {height} AS h FROM {grid})"""


def bit(algorithm: str, side: int, p: str = "p") -> tuple[str, int]:
    """When bit k is set, and how many bits there are."""
    b, s = side * side, side
    at = lambda i: f"{p}[({i}) + 1]"
    if algorithm == "mean":
        return f"{at('k')} * len({p}) >= list_sum({p})", b
    if algorithm == "median":
        return f"{at('k')} > list_sort({p})[len({p}) // 2 + 1]", b
    if algorithm == "gradient":
        i = f"(k // {s - 1}) * {s} + k % {s - 1}"
        return f"{at(i + ' + 1')} > {at(i)}", b - 1
    if algorithm == "vert_gradient":
        i = f"(k % {s - 1}) * {s + 1} + k // {s - 1}"
        return f"{at(f'{i} + {s + 1}')} > {at(i)}", b - 1
    if algorithm == "double_gradient":
        h = b // 2
        i, j = f"(k // {s}) * {s + 1} + k % {s}", f"((k - {h}) % {s}) * {s + 1} + (k - {h}) // {s}"
        return f"CASE WHEN k < {h} THEN {at(i + ' + 1')} > {at(i)} ELSE {at(f'{j} + {s + 1}')} > {at(j)} END", b
    n = s * (s - 1)
    i = f"(k // {s - 1}) * {s} + k % {s - 1}"
    return f"CASE WHEN k < {n} THEN {at(i + ' + 1')} > {at(i)} ELSE {at(f'k - {n} + {s}')} > {at(f'k - {n}')} END", b


def words(algorithm: str, side: int, grid: str = "g", name: str = "hashes") -> str:
    """CTE ``name`` (id, word, hash)."""
    cond, n = bit(algorithm, side)
    return f"""
{name} AS (SELECT id, CAST(k // 64 AS INT) AS word,
                  sum(CASE WHEN NOT ({cond}) THEN 0 WHEN k % 64 = 63 THEN (-9223372036854775808)::HUGEINT ELSE 1::HUGEINT << (k % 64)::INT END)::BIGINT AS hash
           FROM {grid}, range({n}) AS r(k) GROUP BY id, k // 64)"""


def _target(algorithm: str, side: int) -> tuple[int, int]:
    return {"gradient": (side, side + 1), "vert_gradient": (side + 1, side), "double_gradient": (side + 1, side + 1)}.get(algorithm, (side, side))


def hashes(algorithm: str = "mean", side: int = 8, source: str = TEXT, name: str = "hashes") -> str:
    return f"{images(source)}, {resized(*_target(algorithm, side))}, {words(algorithm, side, 'g', name)}"


EMBEDDINGS = "g AS (SELECT vec_id AS id, list_transform(embedding, lambda x: greatest(0, least(255, floor((x::DOUBLE + 1) * 127.5)))::INT) AS p FROM embeddings)"
BENCHMARK = "SELECT item_id AS id, coalesce(text, '') AS text FROM benchmark"


def _two(first: str, second: str) -> str:
    """CTE h (documents) and q (another source), hashed by mean."""
    return f"h AS (WITH {hashes(source=first)} SELECT id, hash FROM hashes), q AS (WITH {hashes(source=second)} SELECT id, hash FROM hashes)"


FIND = f"""WITH {hashes()} SELECT q.id AS query_id, h.id AS match_id, h.hash, bit_count(xor(q.hash, h.hash))::INT AS distance
FROM hashes q, hashes h WHERE q.id % 100 = 0 AND bit_count(xor(q.hash, h.hash)) <= 8"""


def oracle_sql() -> dict[str, str]:
    digest = "SELECT doc_id, sha256(text) AS digest FROM documents"
    out = {
        "sha256_documents": digest,
        "stream_sha256": digest,
        "sha256_hex": "SELECT page_id, sha256(html) AS digest FROM pages",
        "sha256_short": f"{digest} WHERE octet_length(encode(text)) <= 55",
        "sha256_long": f"{digest} WHERE octet_length(encode(text)) > 55",
        "sha256_batched": "SELECT 0 AS batch_id, doc_id AS row_id, sha256(text) AS digest FROM documents UNION ALL SELECT 1, page_id, sha256(html) FROM pages UNION ALL SELECT 2, item_id, sha256(text) FROM benchmark",
        "exact_dup_groups": "SELECT sha256(text) AS digest, count(*) AS copies, min(doc_id) AS first_id FROM documents WHERE text IS NOT NULL GROUP BY text HAVING count(*) >= 2",
        "exact_dedup": "SELECT min(doc_id) AS doc_id FROM documents WHERE text IS NOT NULL GROUP BY text UNION ALL SELECT doc_id FROM documents WHERE text IS NULL",
        "phash_block_16to8": f"""WITH {images()}, {resized(16, 16)},
b AS (SELECT id, list(s // 4 ORDER BY by_, bx) AS p FROM
      (SELECT id, (i // 16) // 2 AS by_, (i % 16) // 2 AS bx, sum(v) AS s FROM (SELECT id, unnest(p) AS v, unnest(range(256)) AS i FROM g) GROUP BY ALL) GROUP BY id),
{words("block", 8, "b")} SELECT id AS doc_id, hash FROM hashes""",
        "resize_box_16": f"WITH {images()}, {resized(16, 16)} SELECT id AS doc_id, array_to_string(list_transform(p, lambda v: printf('%02x', v)), '') AS pixels FROM g",
        "resize_box_16to8": f"WITH {images()}, {resized(16, 16)}, {pixels_of('g', 16, 16, 'k')}, {resized(8, 8, 'e', 'k_px', 'k_im')} SELECT id AS doc_id, array_to_string(list_transform(p, lambda v: printf('%02x', v)), '') AS pixels FROM e",
        "pixel_histogram": f"WITH {images()}, {resized(16, 16)} SELECT id AS doc_id, value, count(*) AS n FROM (SELECT id, unnest(p) AS value FROM g) GROUP BY ALL",
        "hamming_pairs": f"WITH {hashes()}, {words('median', 8, 'g', 'med')} SELECT id AS doc_id, bit_count(xor(a.hash, b.hash))::INT AS distance FROM hashes a JOIN med b USING (id)",
        "hash_index_len": f"WITH {hashes()} SELECT count(hash) AS n FROM hashes",
        "hash_index_bands": f"""WITH {hashes()}, d AS (SELECT hash, count(*) AS n FROM hashes GROUP BY hash),
e AS (SELECT *, band * 64 // 6 AS lo, (band + 1) * 64 // 6 AS hi FROM d, range(6) AS r(band))
SELECT hash, n, band::INT AS band, (hash >> lo::INT) & ((1::BIGINT << (hi - lo)::INT) - 1) AS value FROM e""",
        "hamming_find": f"WITH {hashes()} SELECT id AS doc_id, hash, bit_count(xor(hash, 6148914691236517205))::INT AS distance FROM hashes WHERE bit_count(xor(hash, 6148914691236517205)) <= 28",
        "hamming_find_multi": FIND,
        "hash_index_stored": FIND.replace("<= 8", "<= 5"),
        "hamming_find_brute": FIND,
        "hamming_nearest": f"""WITH {_two(TEXT, BENCHMARK)},
d AS (SELECT q.id AS item_id, h.id AS doc_id, h.hash, bit_count(xor(q.hash, h.hash))::INT AS distance FROM q, h)
SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY distance, hash < 0, hash, doc_id) = 1""",
        "hamming_matrix": f"WITH {hashes(source='SELECT n_nationkey AS id, n_name AS text FROM nation')} SELECT a.id::BIGINT AS id_a, b.id::BIGINT AS id_b, bit_count(xor(a.hash, b.hash))::INT AS distance FROM hashes a, hashes b",
        "near_dup_pairs": f"WITH {hashes()} SELECT a.id AS id_a, b.id AS id_b, bit_count(xor(a.hash, b.hash))::INT AS distance FROM hashes a JOIN hashes b ON a.id < b.id WHERE bit_count(xor(a.hash, b.hash)) <= 5",
        "near_dup_free": f"WITH {_two(TEXT, BENCHMARK)} SELECT id AS item_id FROM q WHERE NOT EXISTS (FROM h WHERE bit_count(xor(q.hash, h.hash)) <= 10)",
    }
    for a in ("mean", "median", "gradient", "vert_gradient", "double_gradient", "block"):
        out[f"phash_{a}_8"] = f"WITH {hashes(a)} SELECT id AS doc_id, hash FROM hashes"
        out[f"phash_{a}_16"] = f"WITH {hashes(a, 16)} SELECT id AS doc_id, word, hash FROM hashes"
        grids = EMBEDDINGS if a in ("mean", "median", "block") else f"{images()}, {resized(*_target(a, 8))}"
        out[f"phash_{a}_8_native"] = f"WITH {grids}, {words(a, 8)} SELECT id, hash FROM hashes"
    return out
