"""Plans: bindings of the provided tables to race-shaped inputs, and the
ordered pipeline of build steps."""
