"""Sparse low-rank factorisation and clustering of large feature tables on Spark."""

from .functions import arrays
from .operators.blocks import map_blocks, pack_blocks, to_numpy
from .operators.least_squares import ridge
from .operators.scoring import accuracy, contingency, f_measure, label_pairs, match_classes
from .operators.tsqr import least_squares_qr, r_matrix, thin_q, tsqr_r
from .operators.weights import nonnegative_least_squares, row_weights
from .plans.compare import compare, default_methods, variance_experiment
from .plans.factorize import Factorization, factorize, fit_basis, initial_basis, repeat_fit
from .plans.separable_nmf import SeparableNMF, separable_nmf
from .session import ship_package
from .sources.delimited import parse_lines, read_delimited, write_basis
from .sources.noise import add_gaussian, add_group_mixture, add_row_mixture
from .sources.planted import banded_basis, normal_basis, planted, random_matrix
from .sources.tables import assign_groups, check_width, from_array, from_columns, from_dense_rows, number_rows, spread_groups

__all__ = [name for name in dir() if not name.startswith("_")]
