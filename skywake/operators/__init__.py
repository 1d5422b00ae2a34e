"""DataFrame operators. None of them runs an action unless its description says so."""
