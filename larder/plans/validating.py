"""All rules over typed records."""

from larder.operators import quality


def findings(products, dims, today, key="gtin", path=None, raw=None):
    """Row-local and cross-record findings of product records."""
    return quality.all_findings(products, dims, today, key, path=path, raw=raw)


def reference_record_findings(brands, ingredients):
    """Source coverage of brand and ingredient records."""
    return quality.reference_findings(brands, "id", ["name", "owner"]).unionByName(
        quality.reference_findings(ingredients, "id", ["aliases", "flags", "explanation"])
    )
