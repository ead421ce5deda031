"""Operators by name, and a place to add own ones.

An operator is a function that takes DataFrames and parameters and returns a
DataFrame; commands of the command line are in `cellweave.cli.COMMANDS`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from cellweave.operators import blend, catalog, focal, geometric, ramp, reclassify

Operator = Callable[..., DataFrame]

OPERATORS: dict[str, Operator] = {
    f.__name__: f
    for f in (
        reclassify.reclassify, reclassify.unmapped, reclassify.duplicate_ids, reclassify.colorize,
        blend.masked_blend, blend.hillshade_blend, blend.shade, blend.biome_layer, blend.render_table,
        focal.proximity, focal.edge_feather, focal.vignette, focal.gaussian_blur, focal.inpaint_mode, focal.fill_nodata, focal.squared_distance,
        geometric.create_subset, geometric.align, geometric.overview, geometric.pyramid, geometric.to_tiles, geometric.from_tiles, geometric.tile_pyramid,
        ramp.parse_ramp, ramp.sort_ramp, ramp.shift_colors, ramp.scale_elevation, ramp.adjust_color_file, ramp.rgb_ramp, ramp.interpolate, ramp.update_line, ramp.color_relief, ramp.qml_lut,
        catalog.list_rasters, catalog.with_sources, catalog.validate_rasters, catalog.presence, catalog.set_tags, catalog.get_tag, catalog.check_options,
    )
}


def operator(name: str) -> Callable[[Operator], Operator]:
    """Registers a function under a name that is still free."""

    def register(f: Operator) -> Operator:
        if name in OPERATORS:
            raise ValueError(f"{name} is registered")
        OPERATORS[name] = f
        return f

    return register
