"""Input tables derived from the driver's Parquet tables.

The text runs unchanged in Spark and in the oracle engine, so both sides start from the same rows.
``{name}`` is a source table or another view.  Where the text would be a join on the slide alone, Spark
builds the same rows with the library's own binned operators (``BUILDERS``).
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.range_join import box_pairs
from tessera.operators.tiling import tile_sets
from tessera.session import parts_for

VIEWS: dict[str, str] = {
    # one slide per supplier
    "fx_slides": """select cast(s_suppkey as int) slide_id, cast(9000+(s_suppkey*37)%4000 as int) proc_w,
 cast(7000+(s_suppkey*53)%3000 as int) proc_h, cast(0.5 as double) proc_mpp,
 case when s_suppkey%5=0 then cast(null as double) when s_suppkey%2=0 then cast(0.25 as double)
 else cast(0.261 as double) end base_mpp from {supplier}""",
    "fx_inst": """select slide_id, inst_id, task, x_min, y_min, x_min+w x_max, y_min+h y_max, type_id from (
 select cast(min(l_suppkey) as int) slide_id, l_orderkey*10+l_linenumber inst_id,
 case min(l_returnflag) when 'R' then 'Gland' when 'A' then 'Lumen' else 'Nuclei' end task,
 cast((min(l_partkey)*7919+l_orderkey*31)%9000 as int) x_min,
 cast((min(l_partkey)*10473+l_orderkey*613+l_linenumber*97)%7000 as int) y_min,
 cast(4+min(l_quantity) as int) w, cast(4+(min(l_partkey)*13+l_linenumber)%29 as int) h,
 cast(min(l_partkey)%7 as int) type_id
 from {lineitem} group by l_orderkey,l_linenumber) q""",
    "fx_n": "select distinct cast(p_size-1 as int) n from {part}",
    "fx_k": "select distinct p_size-1 k from {part}",
    "fx_cells": """select cast(p_partkey%8 as int) image_id, cast(p_partkey as int)+1 inst_id,
 cast(floor(p_partkey/cast(8 as double)) as int) slot, cast(3+p_size%10 as int) side, cast(p_size%4 as int) shift,
 cast(1+p_size%4 as int) cls, cast(1+(p_size+case when p_partkey%7=0 then 1 else 0 end)%4 as int) pcls,
 p_partkey%11=0 miss, p_partkey%13=0 spurious from {part}""",
    "fx_true_px": """select image_id, inst_id, cls, (slot%16)*16+a.k x,
 cast(floor(slot/cast(16 as double)) as int)*16+b.k y
 from {fx_cells} join {fx_k} a on a.k<side join {fx_k} b on b.k<side where not spurious""",
    "fx_pred_px": """select image_id, inst_id+1000000 inst_id, pcls cls, (slot%16)*16+shift+a.k x,
 cast(floor(slot/cast(16 as double)) as int)*16+b.k y
 from {fx_cells} join {fx_k} a on a.k<side join {fx_k} b on b.k<side where not miss""",
    "fx_preds": "select vec_id sample_id, cast(label as int) y_true, embedding from {embeddings}",
    "fx_mask_px": """select slide_id, cast(a.n*50+b.n as int) x, cast(d.n*50+e.n as int) y
 from (select /*+ repartition(64) */ * from {fx_slides}) s join {fx_n} a on a.n*50*64<proc_w join {fx_n} b on (a.n*50+b.n)*64<proc_w
 join {fx_n} d on d.n*50*64<proc_h join {fx_n} e on (d.n*50+e.n)*64<proc_h
 where (cast(floor((a.n*50+b.n)/cast(9 as double)) as int)*3+cast(floor((d.n*50+e.n)/cast(7 as double)) as int)*5+slide_id)%4<>0""",
    "fx_manifest": """select source dataset, lang subdir, cast(doc_id as int) image_id,
 case when doc_id%10<7 then 'train' when doc_id%10<9 then 'valid' else 'test' end split,
 cast(doc_id%3 as int) fold, cast(200+(doc_id*97)%600 as int) w, cast(200+(doc_id*61)%600 as int) h from {documents}""",
    "fx_grid": """select slide_id, cx.n c, cy.n r, cx.n*4032 x0, cy.n*4032 y0, (cx.n+1)*4032 x1, (cy.n+1)*4032 y1,
 proc_w w, proc_h h, case when cy.n=0 then 0 else 1 end ft, case when (cy.n+1)*4032>=proc_h then 0 else 1 end fb,
 case when cx.n=0 then 0 else 1 end fl, case when (cx.n+1)*4032>=proc_w then 0 else 1 end fr
 from {fx_slides} join {fx_n} cx on cx.n*4032<proc_w join {fx_n} cy on cy.n*4032<proc_h""",
    "fx_tiles": """select slide_id,0 as mode,c,r,x0,y0,x1,y1,ft,fb,fl,fr from {fx_grid}
 union all select slide_id,1,c,r,x1-64,y0,x1+64,y1,ft,fb,0,0 from {fx_grid} where fr=1
 union all select slide_id,2,c,r,x0,y1-64,x1,y1+64,0,0,fl,fr from {fx_grid} where fb=1
 union all select slide_id,3,c,r,x1-2*64,y1-2*64,x1+2*64,y1+2*64,1,1,1,1 from {fx_grid} where fr=1 and fb=1""",
    # independent detection per tile: every nucleus clipped to each tile it meets
    "fx_det": """select t.slide_id,t.mode,t.c,t.r,t.x0,t.y0,t.x1,t.y1,t.ft,t.fb,t.fl,t.fr,i.inst_id,
 greatest(i.x_min,t.x0)-t.x0 bx0, greatest(i.y_min,t.y0)-t.y0 by0,
 least(i.x_max,t.x1)-t.x0 bx1, least(i.y_max,t.y1)-t.y0 by1
 from {fx_tiles} t join {fx_inst} i on i.slide_id=t.slide_id and i.task='Nuclei'
 and i.x_max>t.x0 and i.x_min<t.x1 and i.y_max>t.y0 and i.y_min<t.y1""",
    # irregular foreground: 64 x 64 frames filled by line items, 512 orders to a frame
    "fx_blob": """select image_id, x, y, cast(max(q) as int) v from (
 select cast(floor(l_orderkey/cast(512 as double)) as int) image_id,
 cast((l_partkey*31+l_orderkey*7)%64 as int) x, cast((l_partkey*17+l_suppkey*5+l_linenumber*3)%64 as int) y,
 l_quantity q from {lineitem}) s group by image_id, x, y""",
    # the same foreground grown by a cross, so that it has an inside and holes
    "fx_dil": """select distinct image_id, cast(nx as int) x, cast(ny as int) y from (
 select image_id, x nx, y ny from {fx_blob} where v>20 union all select image_id, x+1, y from {fx_blob} where v>20
 union all select image_id, x-1, y from {fx_blob} where v>20 union all select image_id, x, y+1 from {fx_blob} where v>20
 union all select image_id, x, y-1 from {fx_blob} where v>20) q where nx between 0 and 63 and ny between 0 and 63""",
    # instance map over the same frames: one id per 16 x 16 cell, so ids come in disconnected pieces
    "fx_patchwork": """select image_id, x, y, v, cast(1+floor(x/cast(16 as double))+4*floor(y/cast(16 as double)) as int) inst_id,
 cast((v+x)%4 as int) cls from {fx_blob}""",
    # listings of image and companion files
    "fx_files": """select cast(doc_id as int) image_id, source dir, '/data/'||source||'/'||lang||'_'||cast(doc_id as varchar(20))||
 case when n_chars>6000 then '.svs' when n_chars>4500 then '.tif' when n_chars>3000 then '.tiff' when n_chars>1500 then '.ndpi' when n_chars>700 then '.png' else '.txt' end path, n_chars from {documents}""",
    # dense 8 x 8 grey image per embedding
    "fx_grey_pos": "select a.n x, b.n y from {fx_n} a join {fx_n} b on a.n<8 and b.n<8",
    "fx_grey": """select cast(vec_id as int) image_id, cast(label as int) label, p.x, p.y,
 cast(least(greatest(floor((cast(embedding[{base}+p.y*8+p.x] as double)+1)*128),0),255) as int) v
 from {embeddings} join {fx_grey_pos} p on true""",
}

_NAME = re.compile(r"\{(\w+)\}")
_SOURCES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()
# array subscripts start at 0 in Spark and at 1 in the oracle engine
_INDEX_BASE = {"spark": "0", "oracle": "1"}


def _text(name: str, engine: str, views: dict[str, str]) -> str:
    return views[name].replace("{base}", _INDEX_BASE[engine])


def _tiles(fx: "Fixtures") -> DataFrame:
    names = ["slide_id", "mode", "c", "r", "x0", "y0", "x1", "y1", "ft", "fb", "fl", "fr"]
    return tile_sets(fx["fx_slides"]).select(*names)


def _detections(fx: "Fixtures") -> DataFrame:
    """Nuclei and tiles are at most one 4096 cell wide, so both live on the lowest grid level."""
    nuclei = fx["fx_inst"].where("task = 'Nuclei'").select("slide_id", "inst_id", "x_min", "y_min", "x_max", "y_max")
    sides = ("x0", "y0", "x1", "y1")
    pairs = box_pairs(fx["fx_tiles"], nuclei, ["slide_id"], left_box=sides, cell=4096, levels=([0], [0]), split_crowded=False)
    named = pairs.withColumnsRenamed({c: c[2:] for c in pairs.columns if c != "slide_id"})
    return named.where("x_max > x0 and x_min < x1 and y_max > y0 and y_min < y1").selectExpr(
        *fx["fx_tiles"].columns,
        "inst_id",
        "greatest(x_min, x0) - x0 bx0",
        "greatest(y_min, y0) - y0 by0",
        "least(x_max, x1) - x0 bx1",
        "least(y_max, y1) - y0 by1",
    )


CELLS_A_PART = 20_000  # cells that a task turns into pixels, some 60 each
ITEMS_A_PART = 250_000  # line items that a task makes into instances, or whose frames it fills


def _cells(fx: "Fixtures") -> DataFrame:
    """A few megabytes of parts are read by a task or two, so cells are dealt out before they become pixels."""
    n = parts_for(fx["part"], CELLS_A_PART)
    return fx.made("fx_cells").repartition(n, "inst_id")


def _inst(fx: "Fixtures") -> DataFrame:
    """An instance is one line item, so nothing is saved by an aggregate before the exchange, which holds a whole file split."""
    items = fx["lineitem"]
    return fx.made("fx_inst", lineitem=items.repartition(parts_for(items, ITEMS_A_PART), "l_orderkey"))


def _blob(fx: "Fixtures") -> DataFrame:
    """A frame has 64 x 64 pixels, so line items are dealt by it and what is done within frames needs no other exchange."""
    items = fx["lineitem"]
    frame = F.floor(F.col("l_orderkey") / F.lit(512.0)).cast("int")
    return fx.made("fx_blob", lineitem=items.repartition(parts_for(items, ITEMS_A_PART), frame))


def _dil(fx: "Fixtures") -> DataFrame:
    """The cross as rows of one table instead of five, so that a pixel's frame stays where it is."""
    cross = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in ((0, 0), (1, 0), (-1, 0), (0, 1), (0, -1))])
    grown = fx["fx_blob"].where("v > 20").select("image_id", "x", "y", F.explode(cross).alias("o"))
    moved = grown.select("image_id", (F.col("x") + F.col("o.i")).alias("x"), (F.col("y") + F.col("o.j")).alias("y"))
    return moved.where("x between 0 and 63 and y between 0 and 63").distinct()


BUILDERS = {"fx_tiles": _tiles, "fx_det": _detections, "fx_cells": _cells, "fx_inst": _inst, "fx_blob": _blob, "fx_dil": _dil}


class Fixtures:
    """The source tables and derived views of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str, **overrides: str):
        self.spark, self.sf_dir = spark, sf_dir
        self.views = {**VIEWS, **overrides}
        self._made: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._made:
            if name in _SOURCES:
                self._made[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            elif name in BUILDERS:
                self._made[name] = BUILDERS[name](self)
            else:
                self._made[name] = self.made(name)
        return self._made[name]

    def made(self, name: str, **tables: DataFrame) -> DataFrame:
        """The view by its text, from ``tables`` where given."""
        text = _text(name, "spark", self.views)
        return self.spark.sql(text, **{n: tables[n] if n in tables else self[n] for n in set(_NAME.findall(text))})


def with_views(sql: str, views: dict[str, str] = VIEWS) -> str:
    """Prefix oracle text with the views it names, dependencies first."""
    order: list[str] = []

    def need(name: str) -> None:
        if name in views and name not in order:
            for dep in _NAME.findall(views[name]):
                need(dep)
            order.append(name)

    for name in re.findall(r"\bfx_\w+", sql):
        need(name)
    heads = [f"{n} as ({_NAME.sub(lambda m: m.group(1), _text(n, 'oracle', views))})" for n in order]
    body = sql.strip().rstrip(";")
    if not heads:
        return body
    recursive = re.match(r"with\s+recursive\s+", body, re.I)
    plain = re.match(r"with\s+", body, re.I)
    if recursive:
        return "with recursive " + ",\n".join(heads) + ",\n" + body[recursive.end():]
    if plain:
        return "with " + ",\n".join(heads) + ",\n" + body[plain.end():]
    return "with " + ",\n".join(heads) + "\n" + body
