"""Star assembly: the dimensions and facts of one load, built once per rule set."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.calendar import calendar
from tessera.operators import dims, facts
from tessera.sources.bindings import AS_OF, CAL_END, CAL_START, DEFAULT_TEMPS_ID, Staging


class Star:
    """Dimensions and facts over a ``Staging`` set for rule set "a" or "b"."""

    def __init__(self, stg: Staging, rules: str = "a", as_of=AS_OF, cal_start=CAL_START, cal_end=CAL_END,
                 default_key: int = DEFAULT_TEMPS_ID):
        self.stg, self.rules, self.as_of = stg, rules, as_of
        self.cal_start, self.cal_end, self.default_key = cal_start, cal_end, default_key

    @cached_property
    def dim_temps(self) -> DataFrame:
        return calendar(self.stg.spark, self.cal_start, self.cal_end)

    def region_sources(self) -> list[DataFrame]:
        s = self.stg
        src = [s.beneficiaire(), s.maison(), s.offre()]
        if self.rules == "b":
            src = [s.beneficiaire(), s.offre(), s.maison(), s.colonie()]
        return src

    @cached_property
    def dim_region(self) -> DataFrame:
        return dims.dim_region(self.region_sources(), self.rules)

    @cached_property
    def dim_beneficiaire(self) -> DataFrame:
        return dims.dim_beneficiaire(self.stg.beneficiaire(), self.as_of, self.rules, members=self.stg.personne(),
                                     keys=self.benef_keys)

    @cached_property
    def benef_keys(self) -> DataFrame:
        """(source_id, beneficiaire_id): all that the facts need of the dimension."""
        return dims.beneficiaire_keys(self.stg.beneficiaire())

    @cached_property
    def dim_offre(self) -> DataFrame:
        return dims.dim_offre(self.stg.offre())

    @cached_property
    def dim_association(self) -> DataFrame:
        return dims.dim_association(self.stg.association())

    @cached_property
    def dim_maison(self) -> DataFrame:
        return dims.dim_maison(self.stg.maison())

    def fait_operations(self, compat: bool = False, until=None, after=None) -> DataFrame:
        """``until`` / ``after`` restrict the staged operations by date, before any lookup."""
        ops = self.stg.operation()
        if until is not None:
            ops = ops.filter(F.col("date_operation") <= F.lit(until))
        if after is not None:
            ops = ops.filter(F.col("date_operation") > F.lit(after))
        return facts.fait_operations(ops, self.benef_keys, self.dim_offre, self.dim_region,
                                     self.dim_temps, self.rules, compat, self.default_key)

    def fait_solde(self) -> DataFrame:
        return facts.fait_solde(self.stg.solde(), self.benef_keys, self.dim_offre, self.dim_temps,
                                self.rules, self.default_key)

    def fait_activites(self) -> DataFrame:
        return facts.fait_activites(self.stg.activite(), self.stg.rapport(), self.stg.maison(), self.dim_association,
                                    self.dim_maison, self.dim_region, self.dim_temps, self.rules, self.default_key)

    def fait_motatawi3(self, compat: bool = False) -> DataFrame:
        return facts.fait_motatawi3(self.stg.motatawi3(), self.benef_keys, self.dim_region, self.dim_temps,
                                    self.rules, compat, self.default_key)
