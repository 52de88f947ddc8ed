"""Changes, states, reducers and dataflow patterns over DataFrames."""
