"""Errors of the engine.  Each has a stable code, its class name, and the values that its text tells."""

from __future__ import annotations


class AnalyticsError(ValueError):
    """Base of all errors; str() gives the text, ``values`` what it was made of."""

    template = ""

    def __init__(self, **values):
        self.values = values
        super().__init__(self.template.format(**values))

    @property
    def code(self) -> str:
        return type(self).__name__


def _error(name: str, template: str) -> type[AnalyticsError]:
    made = type(name, (AnalyticsError,), {"template": template, "__module__": __name__})
    globals()[name] = made
    return made


for _name, _template in {
    # data
    "EmptySamples": "there are no rows",
    "EmptyFeatures": "there are no feature columns",
    "EmptyTargets": "there are no labels",
    "MismatchedSampleCount": "{features} feature rows stand against {targets} targets",
    "MismatchedFeatureCount": "the model knows {expected} features, the input has {actual}",
    "NonFiniteFeature": "feature {column} of row {row} is NaN, null or infinite",
    "InfiniteFeature": "feature {column} of row {row} is infinite",
    "NegativeFeature": "feature {column} of row {row} is below zero",
    "NonFiniteActualTarget": "the target of row {row} is not finite",
    "NonFinitePrediction": "the result for row {row} is not finite",
    "UnknownLabel": "the label of row {row} was not there when fitting",
    "InvalidClassIndex": "class index {index} of row {row} is not below {classes}",
    "AllValuesMissing": "feature {column} has no value at all",
    "NonFiniteImputationStatistic": "the fill value of feature {column} is not finite",
    # metrics
    "EmptyMetricInput": "a metric needs one row at least",
    "MismatchedMetricInput": "{actual} actual values stand against {predicted} predictions",
    "ConstantTargets": "R2 has no meaning when all targets are equal",
    "NonFiniteMetricResult": "the result of {metric} is not finite",
    "UndefinedClassificationMetric": "{metric} has no value for class {index}",
    "NonFiniteProbability": "the probability of row {row} is not finite",
    "InvalidProbability": "the probability {value} of row {row} is not between 0 and 1",
    "ExpectedBinaryTargets": "two classes are needed, there are {classes}",
    "ExpectedMulticlassTargets": "three classes are needed at least, there are {classes}",
    "PositiveLabelNotFound": "the positive label is not among the actual ones",
    "InsufficientClasses": "{required} classes are needed at least, there are {actual}",
    "MismatchedClassCount": "{expected} classes stand against {actual} probabilities",
    # fitting
    "InsufficientSamples": "{required} rows are needed at least, there are {actual}",
    "RankDeficientDesign": "the columns have rank {rank}, {columns} are needed",
    "NonFiniteSolverOutput": "coefficient {index} is not finite",
    "OptimizationDidNotConverge": "no convergence in {iterations} iterations",
    "WeakLearnerNoBetterThanRandom": "the first weak learner is no better than chance",
    "TooManyComponents": "{maximum} components are possible at most, {requested} were asked for",
    # parameters
    "InvalidTestFraction": "the test fraction must lie between 0 and 1, not be {value}",
    "InvalidFeatureRange": "the feature range needs finite bounds, the lower first, not ({low}, {high})",
    "InvalidImputationConstant": "the fill constant must be finite, not {value}",
    "InvalidFoldCount": "two folds are needed at least, not {value}",
    "InvalidFoldPartition": "fold {fold} does not part the rows",
    "NonFiniteCrossValidationScore": "the score of fold {fold} is not finite",
    "InvalidParameterName": "a parameter's name must not be blank",
    "DuplicateParameter": "parameter {name!r} is there already",
    "EmptyParameterValues": "parameter {name!r} has no values",
    "NonFiniteParameterValue": "value {index} of parameter {name!r} is not finite",
    "ParameterGridTooLarge": "the grid has too many combinations",
    "InvalidRegularization": "regularization must be finite and not below 0, not {value}",
    "InvalidL1Ratio": "the L1 ratio must lie in 0 to 1, not be {value}",
    "InvalidLearningRate": "the learning rate must be finite and above 0, not {value}",
    "InvalidMaxIterations": "one iteration is needed at least, not {value}",
    "InvalidTolerance": "the tolerance must be finite and above 0, not {value}",
    "InvalidNeighborCount": "one neighbour is needed at least, not {value}",
    "InvalidVarianceSmoothing": "variance smoothing must be finite and not below 0, not {value}",
    "InvalidMinSamplesSplit": "a split needs two rows at least, not {value}",
    "InvalidMinSamplesLeaf": "a leaf needs one row at least, not {value}",
    "InvalidEstimatorCount": "one estimator is needed at least, not {value}",
    "InvalidMaxFeatures": "one feature is needed at least, not {value}",
    "InvalidClusterCount": "one cluster is needed at least, not {value}",
    "InvalidComponentCount": "one component is needed at least, not {value}",
    "InvalidRepeatCount": "one repeat is needed at least, not {value}",
    "InvalidAlpha": "alpha must be finite and not below 0, not {value}",
    "InvalidEps": "eps must be finite and above 0, not {value}",
    "InvalidMinSamples": "one row is needed at least, not {value}",
    "InvalidDegree": "the degree must be 1 at least, not {value}",
    "InvalidVarianceThreshold": "the variance threshold must be finite and not below 0, not {value}",
    "InvalidSearchIterations": "one draw is needed at least, not {value}",
    "EmptyCurvePoints": "a curve needs one point at least",
    # files
    "UnsupportedEnvelopeVersion": "model files of version {found} are not supported, those of {supported} are",
    "SerializationError": "the model file can't be read: {reason}",
    "IoError": "the file can't be read or written: {reason}",
    "CsvError": "the CSV data can't be read: {reason}",
    "ArrowError": "the Arrow data can't be read: {reason}",
}.items():
    _error(_name, _template)
