"""Names, types, enums and parameters shared by all models."""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum

RATING = "row int, col int, value float"
TENSOR_CELL = "i int, j int, k int, value float"
CELL4 = "i int, j int, k int, l int, value float"
LABELED_VECTOR = "row_id bigint, label int, idx array<int>, val array<double>"
DOCUMENT = "doc_id bigint, words array<int>, counts array<int>"
FACTORS = "block int, side string, id int, f array<float>, prec array<float>, lag array<float>"
LR_STATE = "block int, feature int, w double, lag double"
TOPIC_WORDS = "topic int, word int, eta double"


class Optimizer(str, Enum):
    CG = "CG"
    LBFGS = "LBFGS"
    CD = "CD"


class Regularizer(str, Enum):
    L1 = "L1"
    L2 = "L2"
    MAX = "MAX"


class Bound(str, Enum):
    JAAKKOLA = "JAAKKOLA"
    BOHNING = "BOHNING"
    TAYLOR = "TAYLOR"


class Loss(str, Enum):
    """Losses by name. Logistic regression has LOGISTIC, factorizations SQUARE; no model has HINGE."""

    LOGISTIC = "LOGISTIC"
    HINGE = "HINGE"
    SQUARE = "SQUARE"


class LrStrategy(str, Enum):
    DGM = "dGM"
    AVGM = "AVGM"
    SAVGM = "sAVGM"
    MEM = "MEM"
    HMEM = "hMEM"
    HECMEM = "hecMEM"
    ADMM = "ADMM"


class MfStrategy(str, Enum):
    DMAP = "dMAP"
    DVB = "dVB"
    AVGM = "AVGM"
    MEM = "MEM"
    HMEM = "hMEM"
    HECMEM = "hecMEM"
    ADMM = "ADMM"


class MfOptimizer(str, Enum):
    ALS = "ALS"
    CD = "CD"
    CDPP = "CDPP"


class LdaStrategy(str, Enum):
    MRLDA = "MRLDA"
    HDLDA = "HDLDA"
    VADMM = "VADMM"


@dataclass(frozen=True)
class LrParams:
    """Options of a logistic regression run. `optimizer` None: CD for block strategies, CG for dGM.

    `ard`: one precision per feature (hMEM, hecMEM). `elastic`: L1 distance from the prior beside the squared one (CD), and
    its global step (hMEM, hecMEM). `t_prior`: (shape, scale) of a heavy-tailed prior (block strategies with CG). `clip`:
    bound of the conjugate factor of CG. `inner_stop`: ends a block's rounds when its likelihood or objective stands still.
    """

    strategy: LrStrategy = LrStrategy.ADMM
    optimizer: Optimizer | None = None
    regularizer: Regularizer = Regularizer.L2
    bound: Bound = Bound.TAYLOR
    blocks: int = 8
    outer: int = 10
    inner: int = 5
    reg: float = 1.0
    rho: float = 1.0
    gamma: float = 1.0
    subsample: float = 0.1
    stop_auc: float = 1e-6
    target_auc: float = 1.0
    include_dual: bool = False
    ard: bool = False
    elastic: float = 0.0
    t_prior: tuple[float, float] | None = None
    clip: float | None = None
    inner_stop: float = 0.0
    seed: int = 0

    def resolved(self) -> Optimizer:
        """The optimizer to use; combinations that can't run raise here, before any job."""
        strategy = LrStrategy(self.strategy)
        opt = self.optimizer and Optimizer(self.optimizer)
        if strategy is LrStrategy.DGM:
            if opt is Optimizer.CD:
                raise ValueError("dGM needs CG or LBFGS")
            return opt or Optimizer.CG
        if self.ard and strategy not in (LrStrategy.HMEM, LrStrategy.HECMEM):
            raise ValueError("ard needs hMEM or hecMEM")
        if self.t_prior is not None and opt is not Optimizer.CG:
            raise ValueError("t_prior needs CG")
        if strategy in (LrStrategy.MEM, LrStrategy.HMEM, LrStrategy.HECMEM):
            if opt not in (None, Optimizer.CD):
                raise ValueError(f"{strategy.value} needs CD")
            return Optimizer.CD
        return opt or Optimizer.CD


@dataclass(frozen=True)
class MfParams:
    """Options of a matrix factorization run. `optimizer` None: ALS for dMAP, CD for dVB, CDPP for block strategies.

    `gamma_cols`: precision of the columns, if it differs. `block_by`: hash or modulo of the ids.
    """

    strategy: MfStrategy = MfStrategy.HECMEM
    optimizer: MfOptimizer | None = None
    regularizer: Regularizer = Regularizer.L2
    rank: int = 10
    row_blocks: int = 2
    col_blocks: int = 2
    outer: int = 5
    inner: int = 3
    reg: float = 0.0
    gamma: float = 1.0
    gamma_cols: float | None = None
    weighted: bool = False
    em_bayes: bool = False
    vb: bool = False
    mean: float = 0.0
    scale: float = 1.0
    stop: float = 0.0
    block_by: str = "hash"
    seed: int = 0

    def resolved(self) -> MfOptimizer:
        strategy = MfStrategy(self.strategy)
        opt = self.optimizer and MfOptimizer(self.optimizer)
        if strategy is MfStrategy.DMAP:
            if opt is MfOptimizer.CDPP:
                raise ValueError("dMAP needs ALS or CD")
            return opt or MfOptimizer.ALS
        if strategy is MfStrategy.DVB:
            if opt not in (None, MfOptimizer.CD):
                raise ValueError("dVB needs CD")
            return MfOptimizer.CD
        if opt is MfOptimizer.ALS:
            raise ValueError(f"{strategy.value} needs CD or CDPP")
        return opt or MfOptimizer.CDPP


@dataclass(frozen=True)
class TfParams:
    """Options of a three-way factorization run."""

    rank: int = 5
    blocks: tuple[int, int, int] = (2, 2, 1)
    outer: int = 3
    inner: int = 4
    reg: float = 0.0
    gamma: tuple[float, float, float] = (1.0, 1.0, 1.0)
    regularizer: Regularizer = Regularizer.L2
    vb: bool = False
    dual: bool = True
    prior: bool = True
    time_factors: bool = True
    frozen_outer: int = 0
    markov: float | None = None
    block_by: str = "hash"
    seed: int = 0


@dataclass(frozen=True)
class LdaParams:
    """Options of a topic model run."""

    strategy: LdaStrategy = LdaStrategy.MRLDA
    topics: int = 10
    blocks: int = 4
    outer: int = 5
    inner: int = 5
    alpha: float = 1.0
    beta: float = 0.1
    update_alpha: bool = False
    fold_in: int = 20
    sample_docs: int = 500
    log_space: bool = False
    seed: int = 0
