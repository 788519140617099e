"""Sources, sinks, projections, filters and record-level windows."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from habitspark import settings as S
from habitspark.functions import text
from habitspark.operators import cleaning as C
from habitspark.operators import tables as TB
from habitspark.sources import occurrences as O
from habitspark.sources import polygons as P
from habitspark.sources import rasters as R
from habitspark.sources import sinks, training
from habitspark.suite import views as V
from habitspark.suite.registry import query
from habitspark.suite.views import with_views

DIRTY = [V.OCC, V.OCC_DIRTY]
STEP = "(CAST(2.5 AS DOUBLE) / 60)"
COUNTRIES = [f"NATION_{i}" for i in range(18)]
COUNTRY_SQL = ", ".join(f"'{c}'" for c in COUNTRIES)
BBOX = (-70.0, -40.0, -45.0, 5.0)
BBOX_SQL = "lon BETWEEN -70.0 AND -45.0 AND lat BETWEEN -40.0 AND 5.0"
COSMO = ["Sp 00", "Sp 07"]
CLEAN_SQL = f"""
in_box AS (SELECT * FROM occ_dirty WHERE lon BETWEEN -82 AND -34 AND lat BETWEEN -56 AND 13),
dedup AS (SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY species, lat, lon ORDER BY ingest_ord) AS rn
          FROM in_box) WHERE rn = 1),
sound AS (SELECT * FROM dedup WHERE NOT (abs(lat) < 1e-9 AND abs(lon) < 1e-9) AND abs(lat) <= 90 AND abs(lon) <= 180
          AND NOT (abs(lat) - floor(abs(lat)) < 1e-9 AND abs(lon) - floor(abs(lon)) < 1e-9)),
thinned AS (SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (
            PARTITION BY species, floor(lon / {STEP}), floor(lat / {STEP}) ORDER BY ingest_ord) AS rn FROM sound) WHERE rn = 1)"""
MIN_FIXTURE = 600


def raw_export(spark, d):
    o = V.occ(spark, d)
    values = {
        "Especie": F.col("species"),
        "Nombre cientifico GBIF": F.concat("species", F.lit(" L.")),
        "Latitud": F.col("lat"),
        "Longitud": F.col("lon"),
        "Incertidumbre (m)": F.col("uncertainty_m"),
        "Pais": F.col("country"),
        "Region / Estado": F.lit(None).cast("string"),
        "Localidad": F.lit(None).cast("string"),
        "Fecha": F.date_format("ts", "yyyy-MM-dd"),
        "Ano": F.col("year"),
        "Tipo de registro": F.lit("HUMAN_OBSERVATION"),
        "Institucion": F.lit(None).cast("string"),
        "Dataset": F.lit("events"),
        "Catalogo": F.col("rec_id").cast("string"),
        "GBIF ID": F.col("rec_id"),
    }
    return o.select(*[c.alias(h) for h, c in values.items()])


RAW_SQL = """SELECT species AS especie, species || ' L.' AS nombre_cientifico, lat, lon, uncertainty_m AS incertidumbre_m,
  country AS pais, CAST(NULL AS VARCHAR) AS region, CAST(NULL AS VARCHAR) AS localidad, strftime(ts, '%Y-%m-%d') AS fecha,
  year AS ano, 'HUMAN_OBSERVATION' AS tipo_registro, CAST(NULL AS VARCHAR) AS institucion, 'events' AS dataset,
  CAST(rec_id AS VARCHAR) AS catalogo, rec_id AS gbif_id FROM occ"""


@query("src_occurrence", with_views([V.OCC], RAW_SQL))
def src_occurrence(spark, d):
    path = sinks.scratch_folder(spark)
    sinks.write_csv(raw_export(spark, d), path)
    return O.read_raw(spark, path)


@query(
    "src_api_pages",
    with_views(
        [V.OCC],
        """SELECT species AS especie, species || ' L.' AS nombre_cientifico, lat, lon, uncertainty_m AS incertidumbre_m,
  country AS pais, CAST(NULL AS VARCHAR) AS region, CAST(NULL AS VARCHAR) AS localidad, strftime(ts, '%Y-%m-%d') AS fecha,
  year AS ano, CAST(NULL AS VARCHAR) AS tipo_registro, CAST(NULL AS VARCHAR) AS institucion,
  CAST(NULL AS VARCHAR) AS dataset, CAST(NULL AS VARCHAR) AS catalogo, rec_id AS gbif_id
  FROM occ WHERE rec_id % 25 < 20 AND rec_id % 83 <> 0""",
    ),
)
def src_api_pages(spark, d):
    o = V.occ(spark, d)
    code = F.when(F.col("rec_id") % 25 < 20, "CL").otherwise("US")
    rec = F.struct(
        F.concat("species", F.lit(" L.")).alias("scientificName"),
        F.when(F.col("rec_id") % 83 != 0, F.col("lat")).alias("decimalLatitude"),
        F.col("lon").alias("decimalLongitude"),
        F.col("uncertainty_m").alias("coordinateUncertaintyInMeters"),
        F.col("country"),
        F.date_format("ts", "yyyy-MM-dd").alias("eventDate"),
        F.col("year"),
        F.col("rec_id").alias("key"),
        code.alias("countryCode"),
    )
    # pages of at most 300 results, as the interface delivers them
    paged = o.select("species", F.floor(F.col("rec_id") / 300).alias("page_no"), rec.alias("r"))
    bodies = paged.groupBy("species", "page_no").agg(
        F.to_json(F.struct(F.collect_list("r").alias("results"), F.lit(False).alias("endOfRecords"))).alias("body")
    )
    pages = bodies.select("species", F.from_json("body", O.PAGE_SCHEMA).alias("page"))
    return O.from_api_pages(pages, F.col("species"))


@query(
    "src_landed_json",
    "SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1, 2",
)
def src_landed_json(spark, d):
    e = V.table(spark, d, "events")
    return (
        e.select("event_type", F.from_json("props", "k BIGINT").alias("p"))
        .groupBy("event_type", F.col("p.k").alias("k"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


CLEAN_FIELDS = T.StructType(
    [
        T.StructField("rec_id", T.LongType()),
        T.StructField("species", T.StringType()),
        T.StructField("lon", T.DoubleType()),
        T.StructField("lat", T.DoubleType()),
        T.StructField("uncertainty_m", T.DoubleType()),
    ]
)


@query("src_csv", with_views(DIRTY, "SELECT rec_id, species, lon, lat, uncertainty_m FROM occ_dirty"))
def src_csv(spark, d):
    path = sinks.scratch_folder(spark)
    sinks.write_csv(V.occ_dirty(spark, d).select(CLEAN_FIELDS.fieldNames()), path)
    return O.read_clean(spark, path, CLEAN_FIELDS)


@query("snk_csv", with_views(DIRTY, "SELECT species, count(*) AS n, count(lat) AS n_lat FROM occ_dirty GROUP BY species"))
def snk_csv(spark, d):
    return src_csv(spark, d).groupBy("species").agg(F.count(F.lit(1)).alias("n"), F.count("lat").alias("n_lat"))


LAYER_SQL = """SELECT row, col, CAST(CAST(elevation AS FLOAT) AS DOUBLE) AS elevation FROM cells"""


@query("src_raster_layer", with_views([V.CELLS], LAYER_SQL))
def src_raster_layer(spark, d):
    nodata = F.when(F.col("col") % 2 == 0, F.lit(S.RASTER_NODATA)).when(F.col("col") % 5 == 0, F.lit(float("nan"))).otherwise(-3.4e38)
    path = sinks.scratch_folder(spark)
    raw = V.cells(spark, d).select("row", "col", F.coalesce(F.col("elevation"), nodata).alias("value"))
    R.write_layer(raw, path)
    layers = R.read_layers(spark, {"elevation": path, "slope": path + "-absent"})
    return layers["elevation"].withColumn("elevation", F.col("elevation").cast("double"))


@query(
    "src_raster_multiband",
    with_views(
        [V.BANDS],
        """SELECT row, col, max(CASE WHEN band = 'b1' THEN value END) AS bio1, max(CASE WHEN band = 'b4' THEN value END) AS bio4,
        max(CASE WHEN band = 'b7' THEN value END) AS bio7 FROM bands_long WHERE band IN ('b1', 'b4', 'b7') GROUP BY row, col""",
    ),
)
def src_raster_multiband(spark, d):
    return R.select_bands(V.bands_long(spark, d), {"b1": "bio1", "b4": "bio4", "b7": "bio7"})


@query("src_polygons", with_views([V.POLYGONS], "SELECT feature_id, name, x1, y1, x2, y2 FROM edges"))
def src_polygons(spark, d):
    path = sinks.scratch_folder(spark)
    V.polygons(spark, d).write.parquet(path)
    assert P.read_polygons(spark, path + "-absent") is None
    return P.edges(P.read_polygons(spark, path), "name")


@query(
    "src_training",
    with_views(
        [V.SCORED],
        "SELECT species, presence, count(*) AS n, count(maxent) AS n_maxent FROM scored WHERE species = 'Sp 03' GROUP BY 1, 2",
    ),
)
def src_training(spark, d):
    path = sinks.scratch_folder(spark)
    s = V.scored(spark, d).withColumn("species_slug", text.slug(F.col("species")))
    s.write.partitionBy("species_slug").parquet(path)
    chosen = spark.createDataFrame(
        [("sp_03", a, i) for i, a in enumerate(S.ALGORITHMS)], "species_slug string, predictor string, position int"
    )
    df, predictors = training.read_training(spark, path, "sp_03", chosen)
    return df.groupBy("species", "presence").agg(F.count(F.lit(1)).alias("n"), F.count(predictors[-1]).alias("n_maxent"))


@query("src_oof", with_views([V.SCORED], "SELECT cv_fold, sum(presence)::BIGINT AS n_presence, count(*) AS n FROM scored GROUP BY cv_fold"))
def src_oof(spark, d):
    path = sinks.scratch_folder(spark)
    assert training.read_oof(spark, path) is None
    V.scored(spark, d).write.parquet(path)
    return training.read_oof(spark, path).groupBy("cv_fold").agg(
        F.sum(F.col("presence").cast("long")).alias("n_presence"), F.count(F.lit(1)).alias("n")
    )


@query(
    "src_discover",
    with_views(
        [V.OCC],
        """SELECT replace(lower(species), ' ', '_') AS species_slug, species FROM occ
        WHERE species IN (SELECT 'Sp ' || lpad(CAST(l_suppkey % 16 AS VARCHAR), 2, '0') FROM lineitem) GROUP BY species""",
    ),
)
def src_discover(spark, d):
    data = V.occ(spark, d).select(text.slug(F.col("species")).alias("species_slug"))
    chosen = V.scored(spark, d).select(text.slug(F.col("species")).alias("species_slug"))
    return training.discover_species(data, chosen)


@query("snk_split_species", with_views([V.OCC], "SELECT replace(lower(species), ' ', '_') AS species_slug, count(*) AS n_records FROM occ GROUP BY species"))
def snk_split_species(spark, d):
    return sinks.split_by_species(V.occ(spark, d), sinks.scratch_folder(spark), branch="main")


@query(
    "snk_raster",
    with_views([V.CELLS], "SELECT row, col, coalesce(elevation, CAST(-9999 AS DOUBLE)) AS elevation FROM cells"),
)
def snk_raster(spark, d):
    cells = V.cells(spark, d)
    valid = cells.filter("elevation IS NOT NULL").select("row", "col", "elevation")
    path = sinks.scratch_folder(spark)
    R.write_layer(R.full_grid(cells, valid, nodata=S.RASTER_NODATA), path)
    return spark.read.parquet(path)


BURN_SQL = """env AS (SELECT species, presence, gam * 30 - 10 AS bio1, rf AS bio4, glm * 60 AS lat FROM scored),
flagged AS (SELECT *, presence = 0 AND (bio1 < -5 OR abs(lat) > 55 OR bio4 = 0) AS burn FROM env)"""


def burn_input(spark, d):
    return V.scored(spark, d).select(
        "species", "presence", (F.col("gam") * 30 - 10).alias("bio1"), F.col("rf").alias("bio4"), (F.col("glm") * 60).alias("lat")
    )


@query(
    "snk_quarantine",
    with_views([V.SCORED, BURN_SQL], "SELECT species, CASE WHEN burn THEN 'burned' ELSE 'kept' END AS part, count(*) AS n FROM flagged GROUP BY 1, 2"),
)
def snk_quarantine(spark, d):
    kept, burned = sinks.scratch_folder(spark), sinks.scratch_folder(spark) + "-burned"
    sinks.quarantine(burn_input(spark, d), C.prune_mask(), kept, burned)
    both = TB.tag(spark.read.parquet(kept), "part", "kept").unionByName(TB.tag(spark.read.parquet(burned), "part", "burned"))
    return both.groupBy("species", "part").agg(F.count(F.lit(1)).alias("n"))


@query(
    "flt_prune_background",
    with_views(
        [V.SCORED, BURN_SQL],
        """SELECT species, count(*) FILTER (presence = 0) AS n_before, count(*) FILTER (burn) AS n_burned,
        count(*) FILTER (presence = 0 AND NOT burn) AS n_after,
        round(CAST(100 AS DOUBLE) * count(*) FILTER (burn) / greatest(1, count(*) FILTER (presence = 0)), 6) AS pct_burned
        FROM flagged GROUP BY species""",
    ),
)
def flt_prune_background(spark, d):
    burn = C.prune_mask()
    bg = F.col("presence") == 0
    counts = burn_input(spark, d).groupBy("species").agg(
        F.count_if(bg).alias("n_before"), F.count_if(burn).alias("n_burned"), F.count_if(bg & ~burn).alias("n_after")
    )
    return counts.withColumn("pct_burned", F.round(F.lit(100.0) * F.col("n_burned") / F.greatest(F.lit(1), F.col("n_before")), 6))


@query("snk_idempotent", with_views([V.OCC], "SELECT species, count(*) AS n FROM occ GROUP BY species"))
def snk_idempotent(spark, d):
    path = sinks.scratch_folder(spark)
    o = V.occ(spark, d)
    sinks.write_parquet_once(o, path)
    sinks.write_parquet_once(o.limit(1), path)
    return spark.read.parquet(path).groupBy("species").agg(F.count(F.lit(1)).alias("n"))


@query("prj_rename_predictors", with_views([V.BANDS_WIDE], "SELECT row, col, b1 AS temp_media_anual, b2 AS precip_anual FROM bands_wide"))
def prj_rename_predictors(spark, d):
    w = V.bands_wide(spark, d).select("row", "col", F.col("b1").alias("bio1"), F.col("b2").alias("bio12"))
    return TB.rename_predictors(w)


DICT_SQL = "dict(code, name, unit) AS (VALUES " + ", ".join(f"('{c}', '{n}', '{u}')" for c, n, _, u in S.PREDICTOR_DICTIONARY) + ")"


@query(
    "prj_dictionary",
    with_views(
        [V.BANDS, DICT_SQL],
        """SELECT code, name, unit, count(*) AS n_cells FROM
        (SELECT CASE band WHEN 'b1' THEN 'bio1' WHEN 'b2' THEN 'bio4' WHEN 'b3' THEN 'bio5' WHEN 'b4' THEN 'bio6'
         WHEN 'b5' THEN 'bio7' WHEN 'b6' THEN 'bio10' ELSE 'bio11' END AS code FROM bands_long) JOIN dict USING (code) GROUP BY ALL""",
    ),
)
def prj_dictionary(spark, d):
    codes = F.create_map(*[x for b, c in zip(V.BAND_NAMES, S.BIOCLIM) for x in (F.lit(b), F.lit(c))])
    bands = V.bands_long(spark, d).select(codes[F.col("band")].alias("code"))
    described = bands.join(F.broadcast(TB.predictor_dictionary(spark)), "code")  # 14 rows
    return described.groupBy("code", "name", "unit").agg(F.count(F.lit(1)).alias("n_cells"))


@query("prj_slug", with_views([V.OCC], "SELECT species, replace(replace(lower(trim(' ' || species || ' var. x ')), ' ', '_'), '.', '') AS slug, count(*) AS n FROM occ GROUP BY 1, 2"))
def prj_slug(spark, d):
    name = F.concat(F.lit(" "), F.col("species"), F.lit(" var. x "))
    return V.occ(spark, d).groupBy("species", text.slug(name).alias("slug")).agg(F.count(F.lit(1)).alias("n"))


@query("prj_unslug", with_views([V.OCC], "SELECT DISTINCT replace(lower(species), ' ', '_') AS slug, species FROM occ"))
def prj_unslug(spark, d):
    s = V.occ(spark, d).select(text.slug(F.col("species")).alias("slug")).distinct()
    return s.select("slug", text.unslug(F.col("slug")).alias("species"))


@query("prj_tag", with_views([V.OCC], "SELECT 'main' AS branch, rec_id, species FROM occ"))
def prj_tag(spark, d):
    return TB.tag(V.occ(spark, d).select("rec_id", "species"), "branch", "main")


@query("prj_reorder", with_views([V.OCC], "SELECT species, lon, lat, CAST(NULL AS DOUBLE) AS slope, CAST(NULL AS VARCHAR) AS region, rec_id, year FROM occ"))
def prj_reorder(spark, d):
    o = V.occ(spark, d).select("rec_id", "lat", "lon", "year", "species")
    return TB.standard_first(o, {"species": "string", "lon": "double", "lat": "double", "slope": "double", "region": "string"})


@query("prj_round", with_views([V.SCORED], "SELECT species, cv_fold, presence, round_even(glm, 4) AS glm, round_even(gam, 4) AS gam, round_even(rf, 4) AS rf, round_even(gbm, 4) AS gbm, round_even(maxent, 4) AS maxent FROM scored"))
def prj_round(spark, d):
    return TB.round_numbers(V.scored(spark, d))


@query(
    "prj_tier",
    with_views([V.SCORED_LONG], "SELECT algo, CASE WHEN score >= 0.9 THEN 'Excelente' WHEN score >= 0.7 THEN 'Confiable' WHEN score >= 0.3 THEN 'Aceptable' ELSE 'Revisar' END AS tier, count(*) AS n FROM scored_long GROUP BY 1, 2"),
)
def prj_tier(spark, d):
    return V.scored_long(spark, d).groupBy("algo", text.reliability_tier(F.col("score")).alias("tier")).agg(F.count(F.lit(1)).alias("n"))


RECORD_SQL = "SELECT rec_id, species, country, lon, lat FROM occ_dirty WHERE "
RECORD = ["rec_id", "species", "country", "lon", "lat"]


@query("flt_country", with_views(DIRTY, RECORD_SQL + f"country IN ({COUNTRY_SQL})"))
def flt_country(spark, d):
    return C.scope(V.occ_dirty(spark, d), "country", COUNTRIES).select(RECORD)


@query("flt_bbox", with_views(DIRTY, RECORD_SQL + BBOX_SQL))
def flt_bbox(spark, d):
    return C.scope(V.occ_dirty(spark, d), "bbox", bbox=BBOX).select(RECORD)


@query("flt_scope_both", with_views(DIRTY, RECORD_SQL + f"country IN ({COUNTRY_SQL}) AND {BBOX_SQL}"))
def flt_scope_both(spark, d):
    return C.scope(V.occ_dirty(spark, d), "both", COUNTRIES, BBOX).select(RECORD)


@query("flt_uncertainty", with_views(DIRTY, "SELECT rec_id, uncertainty_m FROM occ_dirty WHERE uncertainty_m IS NULL OR uncertainty_m <= 10000"))
def flt_uncertainty(spark, d):
    return C.certain_enough(V.occ_dirty(spark, d)).select("rec_id", "uncertainty_m")


SUSPECT_SQL = """flags AS (SELECT *, lat IS NULL OR lon IS NULL AS f_missing,
  coalesce(abs(lat) < 1e-9 AND abs(lon) < 1e-9, false) AS f_zero,
  coalesce(abs(lat) > 90, false) OR coalesce(abs(lon) > 180, false) AS f_range,
  coalesce(abs(lat) - floor(abs(lat)) < 1e-9 AND abs(lon) - floor(abs(lon)) < 1e-9, false) AS f_cut FROM occ_dirty)"""


@query("flt_suspicious", with_views([*DIRTY, SUSPECT_SQL], "SELECT rec_id, species, lon, lat FROM flags WHERE NOT (f_missing OR f_zero OR f_range OR f_cut)"))
def flt_suspicious(spark, d):
    return C.drop_suspicious(V.occ_dirty(spark, d)).select("rec_id", "species", "lon", "lat")


@query(
    "ag_suspicious_counts",
    with_views(
        [*DIRTY, SUSPECT_SQL],
        """SELECT count(*) FILTER (f_missing) AS n_missing, count(*) FILTER (f_zero) AS n_zero,
        count(*) FILTER (f_range) AS n_out_of_range,
        count(*) FILTER (f_cut AND NOT (f_missing OR f_zero OR f_range)) AS n_truncated FROM flags""",
    ),
)
def ag_suspicious_counts(spark, d):
    return C.defect_counts(V.occ_dirty(spark, d))


@query("flt_complete", with_views([V.SCORED], "SELECT species, cv_fold, presence, count(*) AS n FROM scored WHERE maxent IS NOT NULL AND glm IS NOT NULL GROUP BY 1, 2, 3"))
def flt_complete(spark, d):
    return C.complete(V.scored(spark, d), S.ALGORITHMS).groupBy("species", "cv_fold", "presence").agg(F.count(F.lit(1)).alias("n"))


FIXTURE_MIN_SQL = "(SELECT count(*) / 16.5 FROM events)"


def fixture_min(spark, d) -> int:
    n = V.table(spark, d, "events").count()
    return -(-n * 2 // 33)


@query(
    "flt_min_records",
    with_views([V.OCC], f"SELECT rec_id, species FROM occ WHERE species IN (SELECT species FROM occ GROUP BY species HAVING count(*) >= {FIXTURE_MIN_SQL})"),
)
def flt_min_records(spark, d):
    return C.with_enough_records(V.occ(spark, d), fixture_min(spark, d)).select("rec_id", "species")


GROUPS_SQL = f"""counts AS (SELECT species, count(*) AS n_records FROM occ GROUP BY species),
groups AS (SELECT species, n_records, CASE WHEN n_records < {FIXTURE_MIN_SQL} THEN 'C' WHEN species IN ('Sp 00', 'Sp 07') THEN 'A' ELSE 'B' END AS "group" FROM counts)"""


@query("ag_classify", with_views([V.OCC, GROUPS_SQL], 'SELECT species, n_records, "group" FROM groups'))
def ag_classify(spark, d):
    return C.species_groups(V.occ(spark, d), COSMO, fixture_min(spark, d))


@query("ag_label_groups", with_views([V.OCC, GROUPS_SQL], 'SELECT rec_id, species, "group" FROM occ JOIN groups USING (species)'))
def ag_label_groups(spark, d):
    return C.label_groups(V.occ(spark, d), COSMO, fixture_min(spark, d)).select("rec_id", "species", "group")


@query("flt_group", with_views([V.OCC, GROUPS_SQL], "SELECT species FROM groups WHERE \"group\" IN ('A', 'B')"))
def flt_group(spark, d):
    g = C.species_groups(V.occ(spark, d), COSMO, fixture_min(spark, d))
    return g.filter(F.col("group").isin("A", "B")).select("species").orderBy("species")


@query("ag_group_species", with_views([V.OCC, GROUPS_SQL], 'SELECT "group", count(DISTINCT species) AS n_species FROM groups GROUP BY 1'))
def ag_group_species(spark, d):
    g = C.species_groups(V.occ(spark, d), COSMO, fixture_min(spark, d))
    return g.groupBy("group").agg(F.countDistinct("species").alias("n_species"))


@query("flt_valid_cells", with_views([V.CELLS, V.BANDS_WIDE], f"SELECT row, col, elevation, b1, b2 FROM cells JOIN bands_wide USING (row, col) WHERE elevation IS NOT NULL AND b1 IS NOT NULL AND b2 IS NOT NULL AND {BBOX_SQL}"))
def flt_valid_cells(spark, d):
    stack = V.cells(spark, d).join(V.bands_wide(spark, d), ["row", "col"])
    return C.scope(C.complete(stack, ["elevation", "b1", "b2"]), "bbox", bbox=BBOX).select("row", "col", "elevation", "b1", "b2")


@query("flt_failed_topography", with_views([V.SCORED], "SELECT species, count(*) AS n FROM scored WHERE rf = 0 AND gbm = 0 AND presence = 0 GROUP BY species"))
def flt_failed_topography(spark, d):
    return V.scored(spark, d).filter(C.failed_topography(["rf", "gbm", "presence"])).groupBy("species").agg(F.count(F.lit(1)).alias("n"))


def cleaned(df):
    return C.thin(C.drop_suspicious(C.deduplicate(C.scope(df, "bbox"))))


@query("w_dedup", with_views([*DIRTY, CLEAN_SQL], "SELECT rec_id, species, lon, lat FROM (SELECT *, row_number() OVER (PARTITION BY species, lat, lon ORDER BY ingest_ord) AS rn FROM occ_dirty) WHERE rn = 1"))
def w_dedup(spark, d):
    return C.deduplicate(V.occ_dirty(spark, d)).select("rec_id", "species", "lon", "lat")


@query("w_thin", with_views([*DIRTY, CLEAN_SQL], "SELECT rec_id, species, lon, lat FROM thinned"))
def w_thin(spark, d):
    return cleaned(V.occ_dirty(spark, d)).select("rec_id", "species", "lon", "lat")


@query(
    "w_thin_best",
    with_views(
        [V.OCC],
        """SELECT rec_id, species, uncertainty_m FROM (SELECT *, row_number() OVER (PARTITION BY species, floor(lon / 0.5), floor(lat / 0.5)
        ORDER BY uncertainty_m NULLS LAST, ingest_ord) AS rn FROM occ) WHERE rn = 1""",
    ),
)
def w_thin_best(spark, d):
    return C.thin(V.occ(spark, d), 0.5, prefer_certain=True).select("rec_id", "species", "uncertainty_m")


@query(
    "ag_step_funnel",
    with_views(
        [*DIRTY, CLEAN_SQL],
        """SELECT step_no, step, b AS n_before, a AS n_after, b - a AS n_dropped, round(CAST(100 AS DOUBLE) * a / b, 4) AS pct_kept FROM (
        SELECT 1 AS step_no, 'scope' AS step, (SELECT count(*) FROM occ_dirty) AS b, (SELECT count(*) FROM in_box) AS a
        UNION ALL SELECT 2, 'duplicates', (SELECT count(*) FROM in_box), (SELECT count(*) FROM dedup)
        UNION ALL SELECT 3, 'coordinates', (SELECT count(*) FROM dedup), (SELECT count(*) FROM sound)
        UNION ALL SELECT 4, 'thinning', (SELECT count(*) FROM sound), (SELECT count(*) FROM thinned))""",
    ),
)
def ag_step_funnel(spark, d):
    steps = [
        ("scope", lambda x: C.scope(x, "bbox")),
        ("duplicates", C.deduplicate),
        ("coordinates", C.drop_suspicious),
        ("thinning", C.thin),
    ]
    return C.funnel(V.occ_dirty(spark, d), steps)[1]


MODELABLE_SQL = with_views(
    [*DIRTY, CLEAN_SQL],
    """SELECT species, n_records, CASE WHEN n_records < 50 THEN 'C' WHEN species IN ('Sp 00', 'Sp 07') THEN 'A' ELSE 'B' END AS "group"
    FROM (SELECT species, count(*) AS n_records FROM thinned GROUP BY species)""",
)


@query("modelable_species", MODELABLE_SQL)
def modelable_species(spark, d):
    """Records left per species after cleaning, and whether the species can be modelled."""
    return C.species_groups(cleaned(V.occ_dirty(spark, d)), COSMO)


@query("ag_species_count", with_views([V.OCC], "SELECT species, country, count(*) AS n FROM occ GROUP BY 1, 2"))
def ag_species_count(spark, d):
    return V.occ(spark, d).groupBy("species", "country").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "species", "country")


@query(
    "jn_occurrences_by_slug",
    with_views([V.OCC, V.SCORED], "SELECT rec_id, replace(lower(species), ' ', '_') AS slug FROM occ WHERE species IN (SELECT species FROM scored WHERE cv_fold = 0)"),
)
def jn_occurrences_by_slug(spark, d):
    slugs = V.scored(spark, d).filter("cv_fold = 0").select(text.slug(F.col("species")).alias("slug"))
    return TB.records_of_slug(V.occ(spark, d), slugs).select("rec_id", "slug")


@query("u_download_parts", with_views([V.OCC], "SELECT species, count(*) AS n, sum(rec_id)::BIGINT AS id_sum FROM occ GROUP BY species"))
def u_download_parts(spark, d):
    """One multi-path read over landed parts, of which some are empty."""
    o = V.occ(spark, d).select("species", "rec_id", "year")
    base = sinks.scratch_folder(spark)
    cuts = [("early", "year < 2000"), ("none", "year < 1900"), ("late", "year >= 2000")]
    for name, condition in cuts:
        o.filter(condition).write.parquet(f"{base}/{name}")
    parts = spark.read.schema(o.schema).parquet(*[f"{base}/{name}" for name, _ in cuts])
    return parts.groupBy("species").agg(F.count(F.lit(1)).alias("n"), F.sum("rec_id").alias("id_sum"))


@query("u_species", with_views([V.OCC], "SELECT replace(lower(species), ' ', '_') AS slug, rec_id, year FROM occ"))
def u_species(spark, d):
    """The per-species folders read back as one table with the slug in front."""
    path = sinks.scratch_folder(spark)
    sinks.split_by_species(V.occ(spark, d).select("species", "rec_id", "year"), path)
    return spark.read.parquet(path).select(F.col("species_slug").alias("slug"), "rec_id", "year")


@query("ml_hindcast_split", with_views([V.OCC], "SELECT species, count(*) FILTER (year <= 2000) AS n_train, count(*) FILTER (year > 2000) AS n_validate, count(*) AS n FROM occ GROUP BY species"))
def ml_hindcast_split(spark, d):
    period = F.when(F.col("year") <= 2000, "train").when(F.col("year") > 2000, "validate")
    return V.occ(spark, d).withColumn("period", period).groupBy("species").agg(
        F.count_if(F.col("period") == "train").alias("n_train"),
        F.count_if(F.col("period") == "validate").alias("n_validate"),
        F.count(F.lit(1)).alias("n"),
    )
