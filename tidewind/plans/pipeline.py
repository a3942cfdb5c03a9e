"""The study as stages with contracts, from raw bars to the integrity gate, on a file system that the cluster shares.

``python -m tidewind.plans.pipeline --sf-dir DIR --out DIR [STAGE] [--force] [--config FILE] [--also MODEL ..]``
"""

from __future__ import annotations

import argparse
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewind.config import Config, load
from tidewind.operators import errors, evaluate, folds, gate, models, quality
from tidewind.operators.features import canonical, prepared
from tidewind.plans import contracts
from tidewind.plans.store import Store
from tidewind.session import session
from tidewind.sources.bars import lineitem_bars


class GateError(RuntimeError):
    """The integrity gate doesn't pass."""


class Study:
    """Stages that write Parquet under one folder and skip themselves while nothing has changed.

    ``also`` names further models that the comparison trains on the same folds.
    """

    def __init__(self, spark: SparkSession, sf_dir: str, out: str, cfg: Config = Config(), model: str = "lightgbm", also: tuple[str, ...] = ()) -> None:
        self.spark, self.sf_dir, self.cfg, self.model, self.also = spark, sf_dir, cfg, model, also
        self.store = Store(spark, str(out))
        self.stages: dict[str, Callable[[], dict[str, DataFrame]]] = {
            "data_foundation": self._foundation,
            "baseline": self._baseline,
            "model": self._model,
            "validation": self._validation,
            "canonical_oos": self._oos,
            "regime_evaluation": self._evaluation,
            "model_comparison": self._comparison,
            "error_analysis": self._errors,
            "integrity_gate": self._gate,
        }
        self.reads = {
            "data_foundation": ["raw"],
            "baseline": ["canonical"],
            "model": ["canonical", "baseline"],
            "validation": ["canonical", "baseline"],
            "canonical_oos": ["canonical", "model"],
            "regime_evaluation": ["baseline", "model"],
            "model_comparison": ["canonical", "baseline", "model"],
            "error_analysis": ["oos_predictions", "baseline"],
            "integrity_gate": ["raw", "model", "baseline"],
        }
        self.maker = {"canonical": "data_foundation", "baseline": "baseline", "model": "model", "oos_predictions": "canonical_oos"}

    @staticmethod
    def name(table: str) -> str:
        return f"{table}.parquet"

    def path(self, table: str) -> str:
        return self.store.path(self.name(table))

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    def _raw(self) -> None:
        """The raw bars are written once and from then on only read and compared with their recorded hash."""
        if not self.store.exists(self.name("raw")):
            fresh = self.store.write_fresh(lineitem_bars(self.spark, self.sf_dir), self.name("raw"))
            rows = self.spark.read.parquet(self.store.path(fresh))
            record = {"fingerprint": contracts.content_hash(rows), "report": quality.validate_raw(rows)}
            self.store.commit("raw", {self.name("raw"): fresh}, {"raw.json": json.dumps(record)})
        record = self.store.read("raw.json")
        if record is None:
            raise contracts.StaleOutputError("raw bars without provenance")
        if json.loads(record)["fingerprint"] != contracts.content_hash(self.table("raw")):
            raise contracts.StaleOutputError("raw bars are not the recorded ones")

    def _foundation(self) -> dict[str, DataFrame]:
        rows = canonical(prepared(self.table("raw"), self.cfg), self.cfg)
        return {"canonical": rows, "data_dictionary": quality.data_dictionary(self.spark, self.cfg)}

    def _baseline(self) -> dict[str, DataFrame]:
        return {"baseline": evaluate.zero_predictions(self.table("canonical"), self.cfg)}

    def _model(self) -> dict[str, DataFrame]:
        made = models.model_predictions(self.table("canonical"), [self.model], self.cfg)
        return {"model": made.drop("model", "train_mae_diagnostic_only")}

    def _validation(self) -> dict[str, DataFrame]:
        verdict = folds.verdict(self.table("canonical"), self.cfg)
        if verdict["verdict"] != "PASS":
            raise folds.FoldError("; ".join(verdict["reasons"]))
        rows = self.table("canonical")
        faults = quality.canonical_gate(rows, self.cfg).drop("rows").first().asDict()
        again = quality.reload_check(canonical(prepared(self.table("raw"), self.cfg), self.cfg), rows, self.cfg)
        faults |= {r["column_name"]: r["n_different"] for r in again.collect()}  # a row for each column
        if any(faults.values()):
            raise quality.ValidationError(f"canonical rows as read again: {[k for k, v in faults.items() if v]}")
        return {"fold_boundaries": folds.boundary_audit(rows, self.cfg), "reload_check": again}

    def _oos(self) -> dict[str, DataFrame]:
        found = self.table("model")
        trace = folds.traceability(found, self.table("canonical"), self.cfg)
        if trace.where("not traceable").count():
            raise evaluate.PredictionError("predictions are not those of the test blocks")
        return {"oos_predictions": evaluate.check_oos(found)}

    def _evaluation(self) -> dict[str, DataFrame]:
        both = {"baseline_zero": self.table("baseline"), self.model: self.table("model")}
        evaluate.check_fair(*both.values())
        return {"regime_performance": evaluate.regime_performance(evaluate.union_models(both), self.cfg)}

    def _comparison(self) -> dict[str, DataFrame]:
        rows, both = self.table("canonical"), {"baseline_zero": self.table("baseline"), self.model: self.table("model")}
        for name in self.also:
            made = models.model_predictions(rows, [name], self.cfg).drop("model", "train_mae_diagnostic_only")
            evaluate.check_fair(both["baseline_zero"], made)
            both[name] = made
        every = evaluate.union_models(both)
        performance = evaluate.regime_performance(every, self.cfg)
        return {
            "model_predictions": every,
            "model_ranking": evaluate.model_ranking(every, self.cfg),
            "best_models": evaluate.best_models(every, self.cfg),
            "regime_comparison": evaluate.regime_comparison(performance, self.model),
        }

    def _errors(self) -> dict[str, DataFrame]:
        found = errors.with_errors(self.table("oos_predictions"), self.table("baseline"))
        marked, top = errors.ranked(found), errors.top_errors(found)
        return {
            "top_errors": top,
            "error_only": errors.error_only(marked),
            "error_clusters": errors.clusters(top),
            "error_by_fold": errors.shares(marked, "fold_id"),
            "error_by_regime": errors.shares(marked, "regime"),
            "regime_error_stats": errors.regime_stats(found),
            "error_summary": errors.top_overlap(marked).crossJoin(F.broadcast(errors.correlations(found))).crossJoin(F.broadcast(errors.enrichment(marked).drop("k"))),  # a row each
        }

    def _gate(self) -> dict[str, DataFrame]:
        report = gate.audit(self.table("raw"), self.table("model"), self.table("baseline"), self.cfg)
        if report["verdict"] != "PASS":
            raise GateError(f"{report['verdict']}: {', '.join(report['violations'] + report['missing'])}")
        counts = [(k, int(v)) for k, v in sorted(report["counts"].items())]
        return {"integrity_gate": self.spark.createDataFrame(counts, "check_name string, n_violations long")}

    def run(self, name: str, force: bool = False) -> str:
        """``made`` or ``kept``; the tables, the contract and the manifest of a stage come into place together."""
        if name == "data_foundation":
            self._raw()
        inputs = {t: contracts.content_hash(self.table(t)) for t in self.reads[name]}
        at = f"contracts/{name}.json"
        kept = contracts.load(self.store, at)
        if kept is not None and not force:
            contracts.check_inputs(kept, self.cfg.hash(), inputs)
            contracts.check_outputs(self.store, kept)
            return "kept"
        self._same_source(name, inputs)
        moves = {self.name(t): self.store.write_fresh(df, self.name(t)) for t, df in self.stages[name]().items()}
        outputs = {n: contracts.content_hash(self.spark.read.parquet(self.store.path(fresh))) for n, fresh in moves.items()}
        made = contracts.text(contracts.StageContract(name, self.cfg.hash(), inputs, outputs, params={"model": self.model, "also": self.also}))
        self.store.commit(name, moves, {at: made, "manifest.json": self._manifest(name, made)})
        return "made"

    def _same_source(self, name: str, inputs: dict[str, str]) -> None:
        """Predictions made from other canonical rows than the present ones are refused, forced or not."""
        for table in self.reads[name]:
            if table in ("raw", "canonical"):
                continue
            source = inputs.get("canonical") or contracts.content_hash(self.table("canonical"))
            contracts.check_source(contracts.load(self.store, f"contracts/{self.maker[table]}.json"), name, {"canonical": source})

    def run_all(self, force: bool = False) -> dict[str, str]:
        return {name: self.run(name, force) for name in self.stages}

    def _manifest(self, name: str, made: str) -> str:
        found = {n: t for n in self.stages if (t := made if n == name else self.store.read(f"contracts/{n}.json")) is not None}
        return json.dumps({n: json.loads(t) for n, t in found.items()}, indent=2, sort_keys=True)


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("stage", nargs="?", default="all")
    parser.add_argument("--sf-dir", required=True)
    parser.add_argument("--out", required=True)
    parser.add_argument("--config")
    parser.add_argument("--force", action="store_true")
    parser.add_argument("--also", nargs="*", default=[], choices=sorted(models.REGISTRY))
    args = parser.parse_args(argv)
    study = Study(session(), args.sf_dir, args.out, load(args.config) if args.config else Config(), also=tuple(args.also))
    done = study.run_all(args.force) if args.stage == "all" else {args.stage: study.run(args.stage, args.force)}
    print(json.dumps(done))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
