"""Jobs made of several operators, with the intermediate tables they share."""
