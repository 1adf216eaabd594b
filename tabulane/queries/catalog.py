"""All check queries: name -> (run(spark, folder), SQL or None)."""

from tabulane.queries import draws, formulas, models, profiles, stored, tables

CHECKS = {
    **formulas.CHECKS,
    **tables.CHECKS,
    **profiles.CHECKS,
    **draws.CHECKS,
    **models.CHECKS,
    **stored.CHECKS,
}
